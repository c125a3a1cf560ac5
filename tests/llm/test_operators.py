"""Small cases and brute force for the operators of xpanel.llm."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from xpanel.llm import catalog, chat_format, language, license_scan, lm_score, mixing, near_dup, packing, quality, topk_search, warc
from xpanel.llm import words as words_module

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER, PIECES = catalog.WORD_BPE, catalog.PIECE_BPE
WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")

LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(60_000))
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\x0b", "en", "a", 4), (4, "Licensed under the MIT License. CC-BY 4.0", "en", "a", 40), (4, "Licensed under the MIT License. CC-BY 4.0", "en", "a", 40),
    (5, LONG, "en", "b", len(LONG)), (None, "null id", "fr", "b", 7), (6, "über ÜBER naïve £ 你好 \U0001f600 <|im_end|>", "de", None, 9), (7, "12345 ?!", "en", "b", 8),
]


def docs_of(spark, rows=None):
    return spark.createDataFrame(EDGE if rows is None else rows, DOCS)


def with_clash(df):
    """Further columns, named as operators name theirs."""
    names = "score labels epoch words n_words _low _n _found n_tokens block source_weight lang_pred lang_score row entropy kept n_base class_id set_key half key part"
    return df.withColumns({n: F.lit(7) for n in names.split()})


# --- 1 ----------------------------------------------------------------------------------------------------------------


def base_scan(text):
    words = re.findall(license_scan.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_columns_equal_brute_force(spark):
    texts = ["GNU General-Public\nLicense, the mit license mit license", "cc by cc-by CC (BY)", "xcc by", "apache licenses", "gnu general public", None, "", "MIT\x7fLicense é", LONG + " apache license"]
    df = with_clash(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r)[1:6] for r in license_scan.license_report(df).collect()}
    assert got == {i: base_scan(t) for i, t in enumerate(texts)}


def test_license_base_columns_on_the_table(spark):
    got = {r["doc_id"]: tuple(r)[1:6] for r in catalog.op1_license_scan(spark, DATA).collect()}
    assert got == {i: base_scan(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}


def test_license_containment_and_priority(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "Licensed under CC BY-NC 4.0."), (3, "GNU Lesser General Public License v2.1"), (4, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_report(df).collect()}
    assert got == {1: ("gpl,gpl-3.0", 1.0), 2: ("cc-by,cc-by-nc-4.0", 1.0), 3: ("lgpl-2.1", 1.0), 4: ("", 0.0)}
    spans = license_scan.scan_licenses(df).filter("row.doc_id = 3").first()["license_detections"]
    assert [(d["start"], d["end"]) for d in spans] == [(0, 7)]
    assert len(license_scan.rules()) > 200


def test_license_signatures(spark):
    """Identifiers with versions and suffixes, headers and clauses."""
    cases = {
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0-or-later",
        "SPDX-License-Identifier: MS-PL": "ms-pl", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl-2.1-only",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse": "bsd-3-clause",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache,apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
        "GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version": "gpl,gpl-2.0-or-later",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit", "SPDX-License-Identifier: GPL-2.0+": "gpl-2.0-or-later", "SPDX-License-Identifier: MIT-0": "mit-0",
        "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": "classpath-exception-2.0,gpl-2.0-or-later", "SPDX-License-Identifier: AFL-3.0": "afl-3.0",
        "SPDX-License-Identifier: EUPL-1.1": "eupl-1.1", "under LGPL-3.0": "lgpl-3.0", "AGPL-3.0": "agpl-3.0", "MPL-2.0 license": "mpl-2.0", "License: Apache-2.0": "apache-2.0",
        'license = "MIT"': "mit", "https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3.0", "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0", "GPLv2+, GPL v3": "gpl-2.0-or-later,gpl-3.0",
        "llama 3.1 community license": "llama-community", "GNU General Public License v2+ or later": "gpl,gpl-2.0-or-later", "LGPLv2.1+": "lgpl-2.1-or-later", "the gpl and 2 0": "", "SPDX-License-Identifier: PHP-3.01": "php-3.01",
        "BSD-3-Clause-Clear or MIT": "", "SPDX-License-Identifier: BSD-3-Clause-Clear AND (BSD-2-Clause OR ISC)": "bsd-2-clause,bsd-3-clause-clear,isc", "2.0+GPL 1+1=2+": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_report(df).collect()}
    assert got == dict(enumerate(cases.values()))
    documents = df.toPandas()  # noqa: F841
    assert {r[0]: r[6] for r in duckdb.sql(license_scan.oracle()).fetchall()} == got
    spans = license_scan.scan_licenses(df).filter("row.text LIKE '%(MIT OR%'").first()["license_detections"]
    assert [(d["start"], d["end"], d["label"]) for d in spans] == [(3, 4, "mit"), (5, 8, "apache-2.0")]


def test_license_gate_holds_every_rule():
    """Every rule has a word that has to stand in a match and that the gate looks for."""
    for line in license_scan.RULES.strip().splitlines():
        keyword, words = [x.strip() for x in line.split(" | ")][2:]
        fixed = [x.replace("licen[cs]e", "license") for x in words.split() if not x.endswith("?")]
        assert keyword in fixed, line
        assert words.startswith("cc by") or any(all(any(g in alternative for g in license_scan.GATE) for alternative in x.split("|")) for x in fixed), line
    for _, keyword, before, _, after in license_scan.CONTEXTS:
        words = [keyword, *f"{before} {after}".replace("licen[cs]e", "license").split()]
        assert any(all(any(g in alternative for g in license_scan.GATE) for alternative in x.split("|")) for x in words), keyword


# --- 2 ----------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and len(a & b) / len(a | b) >= 0.8:
                lo, hi = sorted((root(ids[x]), root(ids[y])))
                parent[hi] = lo
    return {i: root(i) for i in ids}


def near_copies(seed=0, families=6, each=12):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(each):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 8])):
                text[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(text))
    return list(enumerate(out))


@pytest.mark.parametrize("block", [256, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = near_copies()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_keep_first_with_columns_named_as_its_own(spark):
    docs = docs_of(spark).withColumns({c: F.lit("x") for c in ("_keep_id", "_keep_text", "_alone", "_row", "_id", "_text", "row", "label", "p", "place")})
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=repr) == sorted(map(tuple, near_dup.keep_first(docs_of(spark)).select("doc_id", "text").collect()), key=repr)


def test_near_duplicates_edges_and_first_kept(spark):
    got = {(r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(with_clash(docs_of(spark))).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 7)} <= got
    kept = near_dup.keep_first(docs_of(spark))
    assert kept.columns == docs_of(spark).columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7]
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0


def test_first_kept_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (None, c), (7, c), (8, d), (8, e), (9, e), (None, ""), (None, None), (3, ""), (3, ""), (3, a + " more")]
    kept = near_dup.keep_first(spark.createDataFrame([(i, t, None, "s", j) for j, (i, t) in enumerate(rows)], DOCS))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(3, a + " more"), (None, b), (7, c), (8, d), (8, e), (None, ""), (None, None), (3, "")])


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    el = rng.integers(1, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 5, 200), rng.integers(1, 5, 200)
    a, b = dict(zip(el[:200], wa)), dict(zip(el[100:], wb))
    true = sum(min(a.get(e, 0), b.get(e, 0)) for e in el) / sum(max(a.get(e, 0), b.get(e, 0)) for e in el)
    k = 2000
    sig = near_dup.dart_minhash(np.concatenate([el[:200], el[100:]]), np.concatenate([wa, wb]), np.array([0, 200, 400]), k)
    assert (sig != 0).all() and abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / k)


def test_weighted_copies_are_compared_by_counts(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, " ".join([a] * 2)), (2, " ".join([a] * 3)), (3, " ".join([a] * 30)), (4, " ".join([a] * 29))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dup.near_duplicates(df, weighted=False).collect()} == {1}
    assert [r["class_id"] for r in near_dup.near_duplicates(df, weighted=True).orderBy("doc_id").collect()] == [1, 2, 3, 3]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dup.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}


# --- 3 ----------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs_of(spark), TOKENIZER).collect()
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = Counter((d, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x, *_ in EDGE)
    got = Counter()
    for d in {r["doc_id"] for r in rows}:
        copies = sum(r["doc_id"] == d and r["piece"] == 0 for r in rows)
        got[(d, sum(r["length"] for r in rows if r["doc_id"] == d) // copies)] += copies
    assert got == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    assert len(by) == math.ceil(sum(r["length"] for r in rows) / 2048)


def test_packing_query_equals_the_tokenizer(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = set()
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    rows = catalog.op3_best_fit_packing(spark, DATA).collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert all(r["offset"] == 0 for r in rows if r["length"] == 2048) and len({r["sequence_id"] for r in rows if r["length"] == 2048}) == sum(r["length"] == 2048 for r in rows)


def test_words_apart_encode_as_the_text():
    texts = ["Don't STOP! It's 3,000.50 naïve Straße İstanbul ﬁ 你好 <|endoftext|> a<|startoftext|>b 'tis ÀÉ ́x ΑΣ ΟΔΟΣ. \x1c x\x1fy\xa0z ((a)) ~b` #x# a_b", "", " ", "x" * 3000]
    w = packing.WordTokenizer(TOKENIZER)
    assert w(texts) == [np.array(e.ids, "<u4").tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_letters_outlast_the_memory_of_words(monkeypatch):
    """Words that come again with other marks, or after the memory of words was emptied, are not encoded again."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    w, plain = packing.WordTokenizer(TOKENIZER), []
    encode = w._encode
    monkeypatch.setattr(w, "_encode", lambda texts, *by: plain.extend(texts) or encode(texts, *by))
    texts = ["zzalpha zzbeta, ZZGAMMA.", "zzdelta über Straße", "zzalpha; zzBeta! zzgamma über-", "d'être l'o't zz<|endoftext|>"]
    for t in texts:
        assert w([t]) == [np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert {"zzalpha", "zzbeta", "zzgamma", "über"} <= w.letters.keys()
    assert sum(t.split().count(x) for t in plain for x in ("zzalpha", "zzbeta", "zzgamma", "über")) == 4


def test_ascii_letters_are_encoded_by_merges_alone():
    """As by the whole tokenizer, whatever the letters."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["s", "t", "re", "ve", "ll", "endoftext"]
    w = packing.WordTokenizer(TOKENIZER)
    assert w.merges.normalizer is None
    assert w([" ".join(words)]) == [np.array(w.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()]


def test_best_fit_equals_a_scan():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 500)
    seq, off = packing.best_fit_decreasing(lengths)
    bins, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(c, -k) for k, c in enumerate(bins) if c >= lengths[i]]
        if not fits:
            bins.append(2048)
        want[i] = 2048 - (min(fits)[0] if fits else 2048)
        k = -min(fits)[1] if fits else len(bins) - 1
        bins[k] -= lengths[i]
    assert len(bins) == seq.max() + 1 and all(off[i] == want[i] for i in want)


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_mixing_keeps_all_and_meets_the_limit(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(1, 400), "en", "big" if i % 10 else "small", 1) for i in range(3000)] + [(9001, None, None, None, None), (9002, "", "en", "empty", 0)]
    out = mixing.mix_sources(with_clash(docs_of(spark, rows)), max_repetition=2.0)
    got = out.select("row.doc_id", "row.source", out["n_tokens"]).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count_distinct("doc_id").alias("docs")).collect()
    tokens = {s: sum(-(-len(t or "") // 4) for _, t, _, x, _ in rows if x == s) for s in ("big", "small")}
    by = {r["source"]: r for r in got}
    assert by["big"]["n"] == tokens["big"] and by["small"]["n"] == pytest.approx(2 * tokens["small"], rel=0.01)
    assert sum(r["docs"] for r in got) == len(rows)


def test_mixing_meets_an_entropy(spark):
    rows = [(i, "x" * 40, "en", "abcd"[min(i % 16, 3)], 40) for i in range(1600)]
    w = {r["source"]: r["source_weight"] for r in mixing.mix_sources(docs_of(spark, rows), target_entropy=0.9).select("row.source", "source_weight").distinct().collect()}
    h = -sum(p * math.log(p) for p in w.values())
    assert sum(w.values()) == pytest.approx(1.0) and h == pytest.approx(0.9 * math.log(4), abs=1e-6)


def test_mixing_empty_and_budget(spark):
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    rows = [(i, "x" * 40, "en", "a", 40) for i in range(1000)]
    assert mixing.mix_sources(docs_of(spark, rows), budget_tokens=2500).count() == 250


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "a<\\|b<|", "\\", "<\\\\|", "é<", None, "", "x\ny", "<|im_start|>user\nhi<|im_end|>\n"]
    rows = [(c, t, random.Random(c * 10 + t).choice(["user", "assistant", "sys\ntem\\", None]), texts[(c + t) % len(texts)]) for c in range(9) for t in range(4)] + [(None, 0, "user", "n"), (1, 2, "user", "tie"), (1, 2, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for i, t, role, text in rows if i == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_parts_of_a_long_conversation():
    schema = pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * 3), pa.array(["user", "assistant", "user"]), pa.array([f"t{i}"] * 3)], schema=schema) for i in range(3)]
    parts = [p for b in chat_format._format(iter(batches)) for p in b.column("part").to_pylist()]
    assert parts == [0, 1, 2]
    assert next(chat_format._read_back(chat_format._format(iter(batches)))).column("n_turns").to_pylist() == [9]


def oracle_equals(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cell = lambda x: "" if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) else x
    df = catalog.queries()[name](spark, DATA)
    got = [tuple(map(cell, r)) for r in df.select(*sorted(df.columns)).collect()]
    rel = con.sql(catalog.oracle_sql()[name])
    want = [tuple(map(cell, r)) for r in rel.project(", ".join(sorted(rel.columns))).fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op4_source_mixing", "op5_chat_format", "op7_warc", "op8_lm_scores", "op10_exact_top_k"])
def test_query_equals_sql(spark, name):
    oracle_equals(spark, name)


# --- 6 ----------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["▁", "▁a", "a", "ab", "b", "▁ab"])
    rng = np.random.default_rng(0)
    probs = rng.random((pieces.size + 1, 2))
    names = ["▁", "▁a", "a", "ab", "b", "▁ab"]
    word = "▁abb"

    def brute(rest, lang):
        return 1.0 if not rest else sum(probs[names.index(rest[:k]), lang] * brute(rest[k:], lang) for k in range(1, len(rest) + 1) if rest[:k] in names)

    got = language.log_scores(["abb"], pieces, probs)[0]
    assert got == pytest.approx([math.log(brute(word, i)) for i in range(2)])
    counts = language.expected_counts(["abb"], np.ones((1, 2)), pieces, probs)
    assert counts[names.index("b")].min() >= 1 - 1e-9 and counts.sum(0).max() <= 4 + 1e-9


def test_language_sums_all_segmentations_of_long_words():
    """Runs of letters of any length against a sum in logs, position by position."""
    rng = random.Random(8)
    pieces = language.Pieces(["a", "b", "ab", "ba", "bab", "▁", "▁a", "▁ab", "aab"])
    names = ["a", "b", "ab", "ba", "bab", "▁", "▁a", "▁ab", "aab"]
    probs = np.array([[rng.random() ** 3 / 50 for _ in range(3)] for _ in names] + [[language.UNKNOWN] * 3])
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 22, 23, 24, 200, 200, 3000)] + ["c" * 120, "ab" * 700]
    got = language.log_scores(words, pieces, probs)
    for w, scores in zip(words, got):
        marked = "▁" + w
        for lang in range(3):
            sums = [0.0] + [-math.inf] * len(marked)
            for end in range(1, len(marked) + 1):
                terms = [sums[end - len(p)] + math.log(probs[i, lang]) for i, p in enumerate(names) if marked[:end].endswith(p)]
                if marked[end - 1] not in names:
                    terms.append(sums[end - 1] + math.log(language.UNKNOWN))
                top = max(terms, default=-math.inf)
                sums[end] = top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top
            assert scores[lang] == pytest.approx(sums[-1], rel=1e-9)


def test_language_with_very_many_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 40)
    rows = [(i, ("bonjour le monde " if i % 2 else "guten tag welt ") * 5, ("fr" if i % 2 else "de") if i < 60 else f"x{i}", None, None) for i in range(960)]
    languages, probs = language.learn(docs_of(spark, rows), PIECES)
    assert len(languages) == 40 == probs.shape[1] and {"fr", "de"} <= set(languages)
    got = language.language_report(docs_of(spark, rows), PIECES)
    assert got.count() == 960


def test_language_held_out_accuracy(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchall())
    rows = [r for r in catalog.op6_language_id(spark, DATA).collect() if r["held_out"]]
    assert len(rows) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.97


def test_language_edges(spark):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.language_report(docs_of(spark), PIECES).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0) and got[6][0] != "und"
    assert all(r["lang_pred"] == "und" for r in language.language_report(docs_of(spark).withColumn("lang", F.lit(None).cast("string")), PIECES).collect())
    assert language.language_report(docs_of(spark, []), PIECES).count() == 0
    kept = language.keep_identified(with_clash(docs_of(spark)), PIECES)
    assert kept.columns == with_clash(docs_of(spark)).columns and {5, 6} <= {r["doc_id"] for r in kept.collect()}
    unlabelled = docs_of(spark).withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(unlabelled, PIECES).count() == unlabelled.count()


def test_language_vocabulary_is_whole():
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    letters = {p for p in (m.id_to_piece(i).lower() for i in range(m.get_piece_size())) if p.strip("▁").isalpha() and "▁" not in p[1:]}
    assert set(language.vocabulary(PIECES)) == letters


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_damage(spark, tmp_path):
    big, small = "é<p>" * 400, "x" * 10
    rows = [(1, "http://a b\r\n", big), (5, None, big), (3, "u", small), (4, "u", small), (6, "u", None), (None, "u", big), (5, "u", big)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("warc", F.lit(1)), str(tmp_path / "w"))
    archives = spark.read.parquet(str(tmp_path / "w"))
    got = sorted(((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(archives).collect()), key=str)
    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()
    size = len(big.encode())
    assert got == sorted([(1, "revisit", 5, size, digest(big)), (5, "response", None, size, digest(big)), (5, "response", None, size, digest(big)), (-1, "revisit", 5, size, digest(big)), (3, "response", None, 10, digest(small)), (4, "response", None, 10, digest(small)), (6, "response", None, 0, digest(""))], key=str)
    data = archives.first()["warc"]
    assert len(list(warc.records(bytes(data)))) == archives.first()["n_records"]
    with pytest.raises(warc.WarcError):
        list(warc.records(bytes(data)[:-9]))
    import zlib

    plain = zlib.decompressobj(31).decompress(warc.record(1, "u", b"hello", digest("hello"), None)).replace(b"hello", b"hellO")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.records(press.compress(plain) + press.flush()))


# --- 8 ----------------------------------------------------------------------------------------------------------------


def half_of(i):
    return int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:12], 16) % 2


@pytest.mark.parametrize(("filter_keys", "passes"), [(10**6, 1), (3, 3)])
def test_lm_scores_equal_brute_force(spark, monkeypatch, filter_keys, passes):
    """Every n-gram of the other half counts, with two levels of back-off; with and without filters and broadcast words."""
    if filter_keys == 3:
        monkeypatch.setattr(lm_score, "BROADCAST_WORDS", 3)
    rows = [(i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()] + [(-1, None), (-2, "?"), (-3, "one"), (-4, "one two"), (-5, "a a a a b a a"), (None, "no id here")]
    words = {i: WORD.findall((t or "").lower()) for i, t in rows}
    c = {g: Counter(tuple(ws[i : i + k]) for d, ws in words.items() if half_of(d) != g for k in (1, 2, 3) for i in range(len(ws) - k + 1)) for g in (0, 1)}
    n = {g: sum(len(ws) for d, ws in words.items() if half_of(d) != g) for g in (0, 1)}

    def backoff(seen, g):
        if len(seen) == 1:
            return (c[g][seen] or 0.4) / n[g]
        return c[g][seen] / c[g][seen[:-1]] if c[g][seen] else 0.4 * backoff(seen[1:], g)

    got = lm_score.score_corpus(spark.createDataFrame(rows, "doc_id long, text string").withColumn("half", F.lit(7)), filter_keys, passes).collect()
    assert len(got) == len(rows)
    levels = Counter()
    for r in got:
        ws, g = words[r["doc_id"]], half_of(r["doc_id"])
        grams = [tuple(ws[max(i - 2, 0) : i + 1]) for i in range(len(ws))]
        levels.update(next((len(x[k:]) for k in range(len(x)) if c[g][x[k:]]), 0) for x in grams)
        want = [math.log10(backoff(x, g)) for x in grams]
        assert r["n_words"] == len(ws) and r["score"] == (pytest.approx(sum(want) / len(ws), abs=2e-6) if ws else None)
    assert min(levels[k] for k in range(4)) > 0  # every level of back-off takes place
    assert lm_score.score_corpus(docs_of(spark, [])).count() == 0


def test_lm_texts_of_one_id_and_long_texts(spark, monkeypatch):
    whole = lm_score.score_corpus(docs_of(spark)).collect()
    monkeypatch.setattr(words_module, "PIECE_BYTES", 50)
    monkeypatch.setattr(lm_score, "CHUNK", 50)
    assert sorted(map(str, lm_score.score_corpus(docs_of(spark)).collect())) == sorted(map(str, whole))
    assert len(whole) == len({d for d, *_ in EDGE})


def test_lm_scores_read_and_hash_texts_once(spark):
    """Words are counted, and n-grams of each level asked for, from one table of hashed words."""
    texts, seen = docs_of(spark, [(i, f"w{i % 7} w{i % 5} w{i % 3}", None, None, None) for i in range(200)]), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert lm_score.score_corpus(texts.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")).count() == 200
    assert seen.value == 200


@pytest.mark.parametrize("most", [2, 10**6])
def test_lm_counts_of_any_width(spark, most):
    """Counts beyond one and two bytes, in chunks of any number of distinct words, whether or not the words are broadcast."""
    rows = [(1, "a b c"), (2, "a b c"), (3, "a b c"), (4, " ".join(["a b c"] * 70_000)), (5, " ".join(f"w{i}" for i in range(70_000)))]
    got = {r["doc_id"]: r for r in lm_score.score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), most).collect()}
    words = {i: t.split() for i, t in rows}
    for i in (1, 2, 3):
        others = [ws for d, ws in words.items() if half_of(d) != half_of(i)]
        c = {k: Counter(tuple(ws[j : j + k]) for ws in others for j in range(len(ws) - k + 1)) for k in (1, 2, 3)}
        n = sum(map(len, others))
        assert c[3]["a", "b", "c"]
        want = math.log10(c[1]["a",] / n) + math.log10(c[2]["a", "b"] / c[1]["a",]) + math.log10(c[3]["a", "b", "c"] / c[2]["a", "b"])
        assert got[i]["score"] == pytest.approx(want / 3, abs=2e-6)
    assert [got[i]["n_words"] for i in (1, 4, 5)] == [3, 210_000, 70_000]


def test_word_pieces_do_not_change_words():
    texts = ["", None, "Hello, World hello", " a", "ÉCOLE école" * 9, "z" * 300 + " " + "z" * 301, " ".join(f"w{i % 91}" for i in range(3000))]
    whole, cut = words_module.word_hashes(texts), words_module.word_hashes(texts, 40)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert list(np.diff(whole[1])) == [len(WORD.findall((t or "").lower())) for t in texts]
    flat = [w for t in texts for w in WORD.findall((t or "").lower())]
    assert len(set(zip(flat, whole[0].tolist()))) == len(set(flat)) == len(set(whole[0].tolist()))


# --- 9 ----------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n", "a b c a b c", "x\x85y\xa0z w a\x1cb", "l\nl\n \n \nl\r\nl", "a a a a a", "#*$%&|<> \U0001f600é", "a b c d a b c e a b c"])
def test_base_counts(text):
    assert quality.base_counts(text) == brute_counts(text)


def test_base_counts_on_the_table(spark):
    got = {r["doc_id"]: tuple(r)[1:6] for r in catalog.op9_quality_rules(spark, DATA).collect()}
    assert got == {i: brute_counts(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}


def brute_kneser_ney(counts, order):
    """Straight from the definition, over dictionaries of strings."""
    levels = {order: dict(counts)}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    out = {"": 1 / len(levels[1])}
    for m in range(1, order + 1):
        level = levels[m]
        n = [max(sum(v == i for v in level.values()), 1) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = lambda v: min(max((0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])[min(v, 3)], 0), min(v, 3))  # noqa: E731, B023
        total, back = Counter(), Counter()
        for g, v in level.items():
            total[g[:-1]] += v
            back[g[:-1]] += d(v)
        out |= {g: (v - d(v)) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * out[g[1:]] for g, v in level.items()}
    return {g: out[g] for g in counts}


def brute_verdicts(rows, order=5):
    """doc_id -> (kept, cross entropy) of (doc_id, text, lang)."""
    grams = {i: [("\n" * (order - 1) + t)[k : k + order] for k in range(len(t))] for i, t, _ in rows if t}
    p = brute_kneser_ney(Counter(g for gs in grams.values() for g in gs), order)
    entropy = {i: -sum(math.log(p[g]) for g in gs) / len(gs) for i, gs in grams.items()}
    failed = {i: (lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0])(brute_counts(t)) for i, t, _ in rows}
    scored = {i: lang for i, _, lang in rows if not failed[i]}

    def band(ids):
        bins = sorted(round(entropy[i] * 10000) for i in ids)
        low, mid, high = (bins[math.ceil(len(bins) * q) - 1] / 10000 for q in (0.16, 0.5, 0.84))
        return mid - quality.LOW * max(mid - low, quality.LEAST), mid + quality.HIGH * max(high - mid, quality.LEAST)

    every = band(scored)
    own = {lang: band([i for i in scored if scored[i] == lang]) for lang in set(scored.values()) if sum(x == lang for x in scored.values()) >= quality.MIN_BAND}
    return {i: (not failed[i] and own.get(lang, every)[0] <= entropy[i] <= own.get(lang, every)[1], entropy.get(i)) for i, _, lang in rows}


def odd_documents():
    """Documents of one vocabulary, with some of other letters (above the band) and some that vary one pattern (below it)."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)), "en" if i % 2 else "fr") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choice("zqxjkvwбгд|#") for _ in range(5)) for _ in range(60)), "en") for i in range(3)]
    return rows + [(2000, " ".join(w for k in range(40) for w in ("aaaa", "aaaa", f"b{k}b")), "fr"), (2001, "short", "en"), (2002, None, None), (2003, "", "fr")]


@pytest.mark.parametrize(("broadcast_rows", "max_parts"), [(10**6, 16), (4000, 16), (3, 2)])
def test_kept_equals_brute_force_and_both_ends_reject(spark, broadcast_rows, max_parts):
    rows = odd_documents()
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    got = {r["doc_id"]: r for r in quality.quality_report(docs, broadcast_rows=broadcast_rows, max_parts=max_parts).collect()}
    want = brute_verdicts(rows)
    assert {i: r["kept"] for i, r in got.items()} == {i: k for i, (k, _) in want.items()}
    for i, (_, entropy) in want.items():
        assert got[i]["perplexity"] == (None if entropy is None else pytest.approx(math.exp(entropy), rel=1e-4))
    assert not any(got[i]["kept"] for i in (1000, 1001, 1002, 2000)) and not got[2000]["base_failed"] and sum(got[i]["kept"] for i in range(300)) >= 298


def test_kneser_ney_equals_the_definition(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abbcdé") for _ in range(400))
    counts = Counter(text[i : i + 3] for i in range(len(text) - 2))
    got = {r["gram"]: r["p"] for r in quality.kneser_ney(spark.createDataFrame(list(counts.items()), "gram string, n long"), 3).collect()}
    assert got == pytest.approx(brute_kneser_ney(counts, 3))


def test_long_texts_are_cut_without_a_change():
    texts = ["abc" * 500, None, "x", "", "длинный текст " * 90]
    flat = lambda size: sorted((int(o), int(k)) for keys, owners, _, _ in quality.text_grams(texts, 5, size) for k, o in zip(keys, owners))
    assert flat(10**6) == flat(37) == flat(4) and len(flat(4)) == sum(len(t or "") for t in texts)
    assert quality.base_counts("w1 w2 w3 " * 5000) == brute_counts("w1 w2 w3 " * 5000) and len(quality.word_keys("ab cd " * 100, 7)) == 200


def test_quality_edges_and_columns(spark):
    docs = with_clash(docs_of(spark))
    got = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    assert got[1]["base_failed"] and not got[1]["kept"] and got[1]["perplexity"] is None and got[5]["n_words"] == 60_000
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns
    assert quality.quality_report(docs_of(spark, [])).count() == 0


# --- 10 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [4096, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard)
    rng = np.random.default_rng(3)
    vectors = {i: [float(x) for x in rng.integers(-3, 4, 6) / 256] for i in range(300)} | {300: None, 301: [1.0, None], 302: [math.nan] * 6, 303: [math.inf] * 6, 350: [1.0, 2.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    ok = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk_search.top_k(df).collect()} == want
    assert topk_search.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [4096, 7])
def test_every_repeated_row_is_a_candidate(spark, monkeypatch, shard):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])] + [(4, [0.5, 0.0])] * 20
    got = [(r["query_id"], r["vec_id"]) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1), (0, 1), (0, 1), (0, 3), (0, 2)]


def test_top_k_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [-1e18, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    big = 2**63 - 1
    assert [tuple(r) for r in topk_search.top_k(df).orderBy("rank").collect()] == [(0, 1, 1, big), (0, 2, 3, big), (0, 3, 2, -(2**63))]
