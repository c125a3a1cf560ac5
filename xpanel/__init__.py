"""Cross-sectional panel research on Spark: factor panels, walk-forward scoring, portfolio evaluation."""
