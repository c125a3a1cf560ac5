"""Brute force and edge cases for the filter audit, line dedup and centroid clustering."""

import hashlib
import math
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from conftest import DATA
from test_operators import EDGE, LONG, docs_of, with_clash

from xpanel.llm import catalog, centroids, filter_audit, line_dedup

# --- 11 ---------------------------------------------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"
PROSE = " ".join(f"word{i}" for i in range(120))


def audit_by_walking(docs, labels):
    """Every order, document by document: docs are (doc_id, text, lang)."""
    good, toxic = ({x[0] for x in labels if x[c] == 1 and x[0] is not None} for c in (1, 2))
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    masks = []
    for i, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        masks.append("".join(f for f in fails if fails[f]))
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        own = [(docs[n][0], m) for n, m in enumerate(masks) if (docs[n][2] or "") == part]
        by_letter = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                by_letter[f] += len(gone)
                failing = sum(f in m for _, m in own)
                rows[part, order, step] = [len(left), len(gone), failing - len(gone), sum(m == f for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        out |= {k: (*v, by_letter[k[1][k[2] - 1]]) for k, v in rows.items()}
    return out


def found_audit(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_walking_every_order_on_edges(spark):
    random.seed(3)
    texts = [None, "", PROSE, PROSE.upper(), PROSE + " | #", "a b " * 80, "ABC " * 120 + "$", LONG, " \n\t\x0b", "über " * 100]
    docs = [(i // 2 if i % 7 else None, texts[random.randrange(len(texts))], random.choice(["en", "de", None, ""])) for i in range(160)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 80, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    df = with_clash(docs_of(spark, [(i, t, lang, None, None) for i, t, lang in docs]))
    got = found_audit(filter_audit.audit_filters(df, with_clash(spark.createDataFrame(labels, LABELS))))
    assert got == audit_by_walking(docs, labels)


def test_audit_equals_walking_every_order_on_the_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{DATA}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{DATA}/labels.parquet'").fetchall()
    assert found_audit(catalog.op11_filter_audit(spark, DATA)) == audit_by_walking(docs, labels)


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_filters(docs_of(spark, []), none).count() == 0
    assert filter_audit.audit_filters(docs_of(spark), none).count() == 600 * len({r[2] or "" for r in EDGE})


@pytest.mark.parametrize("n", [1, 3, 5])
def test_intervals_cover_each_order_once(n):
    orders = list(permutations(range(n)))
    where = {}
    for mask, step, start, stop in filter_audit.intervals(n):
        for rank in range(start, stop):
            assert (mask, rank) not in where
            where[mask, rank] = step
    for mask in range(1, 1 << n):
        for rank, order in enumerate(orders):
            assert where[mask, rank] == next(s for s, f in enumerate(order, 1) if mask >> f & 1)


# --- 12 ---------------------------------------------------------------------------------------------------------------


def lines_by_hand(docs, min_docs, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(line_dedup.BLANK))
    holders = {}
    for n, (_, text) in enumerate(docs):
        for x in (text or "").split("\n"):
            holders.setdefault(key(x), set()).add(n)
    gone = {k for k, v in holders.items() if len(k) >= least and len(v) >= min_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


SHARED = ["Share this page", "  SHARE THIS PAGE\t", "share This page\x0b", "ÜBER uns", "über uns", "Read more", "", " ", "\x0b\x0c", "|", "x" * 5000]


@pytest.mark.parametrize(("min_docs", "least", "batches"), [(3, 1, 1), (3, 1, 5), (10, 1, 8), (2, 4, 3)])
def test_lines_equal_brute_force(spark, min_docs, least, batches):
    random.seed(min_docs)
    docs = [(i, t) for i, t, *_ in EDGE] + [(i // 2, "\n".join(random.choice([*SHARED, f"own {random.randrange(40)}"]) for _ in range(random.randrange(9)))) for i in range(60)]
    docs += [(77, "\n".join(SHARED[:3]))] * 4 + [(None, None), (None, "Read more"), (99, "\n".join(f"own {i % 50}\nRead more\nline {i}" for i in range(3000))), (98, "\n" * 2000)]
    df = with_clash(docs_of(spark, [(i, t, None, None, None) for i, t in docs])).withColumnRenamed("key", "_dropped").withColumnRenamed("half", "_k").withColumnRenamed("part", "line")
    got = line_dedup.dedup_lines(df, min_docs, least, batches)
    assert set(got.select("row.*").columns) == set(df.columns)
    assert sorted((tuple(r) for r in got.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr) == lines_by_hand(docs, min_docs, least)


def test_lines_equal_brute_force_on_the_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in lines_by_hand(docs, 10, 1))
    assert sorted(tuple(r) for r in catalog.op12_line_dedup(spark, DATA).collect()) == want


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_report(docs_of(spark, [])).count() == 0


def test_runs_are_merged_by_levels_and_without_an_exchange(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), min_docs=3)
    sizes = []
    for b in range(7):
        runs.add(spark.createDataFrame([(x, 1) for x in range(b, b + 40)], "line long, docs long"))
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]]
    plan = runs._merged(*[level[0] for level in runs.levels[:2]])._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    counts = {r["line"]: r["docs"] for name in runs.live() for r in spark.table(name).collect() if r["docs"] >= 3}
    assert set(counts) <= {x for x in range(46) if sum(b <= x < b + 40 for b in range(7)) >= 3}
    assert sorted(r["line"] for r in runs.decided().collect()) == [x for x in range(46) if sum(b <= x < b + 40 for b in range(7)) >= 3]
    assert len(runs.live()) == 1
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


# --- 13 ---------------------------------------------------------------------------------------------------------------


def clusters_by_hand(rows, k, rounds, dim, scale):
    usable = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, [max(-(2**63), min(2**63 - 1, x)) for x in v]) for i, v in usable]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in usable)[:k]
    points = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), j) for j, p in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in usable:
            groups.setdefault(near(v)[1], []).append(v)
        points = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else p for j, p in enumerate(points)]
    cap = lambda x: min(x, 2**63 - 1)
    found = [(i, *near(v)[::-1]) for i, v in usable]
    inertia = [sum(cap(d) for _, c, d in found if c == j) for j in range(len(points))]
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted([(i, c, cap(d), cap(inertia[c]), cap(sum(inertia)), digest[c]) for i, c, d in found], key=repr)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_clusters_on_the_table_equal_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall()
    assert sorted((tuple(r) for r in catalog.op13_centroids(spark, DATA).collect()), key=repr) == clusters_by_hand(rows, 16, 3, 64, 64)


@pytest.mark.parametrize(("k", "rounds", "big"), [(1, 2, 1.0), (2, 0, 1.0), (5, 4, 1.0), (40, 3, 1.0), (4, 3, 1e17), (4, 2, 1e300)])
def test_clusters_of_edges_equal_brute_force(spark, k, rounds, big):
    rng = random.Random(k)
    rows = [(i // 3, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(150)]  # many ties and repeated rows
    rows += [(7, None), (8, [1.0, None, 0.0]), (9, [1.0, math.nan, 0.0]), (9, [1.0, math.inf, 0.0]), (10, [1.0, 2.0]), (11, []), (None, [0.5, 0.5, 0.5]), (12, [big, -big, 0.0]), (13, [big, big, big])]
    df = with_clash(vectors_of(spark, rows)).withColumnRenamed("key", "cluster").withColumnRenamed("half", "v").withColumnRenamed("part", "distance")
    got = centroids.cluster_report(df, k=k, rounds=rounds, dim=3, scale=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == clusters_by_hand(rows, k, rounds, 3, 2)


def test_clusters_of_few_or_no_vectors(spark):
    assert centroids.cluster_report(vectors_of(spark, [])).count() == 0
    assert centroids.cluster_report(vectors_of(spark, [(1, [1.0])])).count() == 0
    rows = [(i, [float(i)]) for i in range(3)]
    assert sorted(tuple(r) for r in centroids.cluster_report(vectors_of(spark, rows), dim=1).collect()) == clusters_by_hand(rows, 16, 3, 1, 64)


def test_search_keeps_bounds_and_compares_few(spark):
    """Over moving centroids: the nearest and second-nearest are exact where they are looked for, and most distances are not computed."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, (24, 8))
    v = centres[rng.integers(0, 24, 4000)] + rng.integers(-6, 7, (4000, 8))
    points, before, asked = centres + rng.integers(-3, 4, (24, 8)), None, 0
    state = [np.zeros(4000, np.int32), np.ones(4000, np.int32), np.full(4000, np.inf), np.zeros(4000)]
    for _ in range(6):
        c = centroids.Centroids(points.tolist(), before, 8)
        asked += centroids.assign(v, *state, c)
        d = ((v[:, None, :] - points[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        assert (np.sqrt(d.min(1)) <= state[2]).all() and (state[2] >= 0).all()
        rest = np.where(np.arange(24)[None] == state[0][:, None], np.inf, d)
        assert (np.sqrt(rest.min(1)) >= state[3]).all()
        before, points = points.tolist(), np.array([v[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else points[j] for j in range(24)])
    assert asked < 0.2 * 6 * v.shape[0] * 24
