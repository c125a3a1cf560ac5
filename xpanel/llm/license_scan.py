"""Licence detection with ordered signature rules, in DataFrame functions only.

A text is reduced to its words, each written as ``<word>``, so a rule is a regular expression over words and an
interval of word positions. A rule runs only where its keyword occurs. Every match is a detection with the rule's
priority; a detection is suppressed if its interval lies within that of a detection of the same or a higher priority
(lower number; of equal intervals the earlier rule stays). Identifiers (``Apache-2.0``, ``GPLv2+``) are one grammar with versions, not a
rule each; every identifier of an expression (``MIT OR Apache-2.0``) is a detection with its own interval.
All work on a document happens inside its row: no shuffle.

Null and empty texts have no words and no detections. Repeated rows are kept; scan_licenses gives the columns of docs as one struct
`row`, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xpanel.llm.common import nested
from xpanel.llm.license_rules import CONTEXTS, CREATIVE_COMMONS, GNU, RULES, SHARED, UNVERSIONED, VERSIONED

#: Fixed values of the base scan: words, and phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = f"[{WORD[2:-2]}]+"

#: Substrings of the lower-cased text, one of which every rule's matches contain.
GATE = ("licen", "gpl", "copyright", "cc0", "creative", "public", "permi", "redistribut", "warrant", "software", "copying", "rights", "wtfpl")

CONFIDENCE = (1.0, 0.9, 0.6, 0.3)  #: by priority

#: "2.0+" ends in the word "0⁺", so a "+" counts and adds no word.
PLUS, PLUS_AT = "⁺", r"([0-9])\+(" + SEPARATORS[:-1] + "|$)"


def _pattern(words: str) -> str:
    """A word pattern as a regular expression over ``<word><word>``; a word that ends in a digit may have a plus."""
    plus = lambda w: f"(?:{w}){PLUS}?" if w[-1:].isdigit() else f"(?:{w})"
    return "".join(f"(?:<{plus(w[:-1])}>)?" if w.endswith("?") else f"<{plus(w)}>" for w in words.split())


def identifiers(which: str) -> str:
    """A regular expression over words for the identifiers of a context: gnu, cc (after their address), versioned, own (with names used for nothing else) or any."""
    creative = [f"cc-{line}" for line in CREATIVE_COMMONS.strip().splitlines()]
    lines = {"gnu": GNU, "cc": CREATIVE_COMMONS}.get(which, "\n".join([GNU, VERSIONED, *creative])).split("\n")

    def versions(name: str, *numbers: str) -> str:
        pairs = [n.split(".") for n in numbers]
        ends = [f"(?:><v?|v){major}><{minor}{PLUS}?>" for major, minor in pairs] + [f"(?:><)?v{major}{PLUS}?>" for major, minor in pairs if minor == "0"]
        return f"<{name.replace('-', '><')}(?:{'|'.join(ends)})(?:<only>|<or><later>)?"

    found = [versions(*line.split()) for line in lines if line]
    names = {"own": UNVERSIONED, "any": f"{UNVERSIONED} {SHARED}"}.get(which, "")
    found += [f"<{name.replace('-', '><')}>" for name in sorted(names.split(), key=len, reverse=True)]
    return f"(?:{'|'.join(found)})"


def contexts() -> list[tuple[int, int, str, str, str, str]]:
    """(rule, priority, keyword, expression of identifiers, identifier, start of the label); these rules come before the others."""
    out = []
    for i, (priority, keyword, before, which, after) in enumerate(CONTEXTS):
        one = identifiers(which)
        out.append((i - len(CONTEXTS), priority, keyword, f"{_pattern(before)}{one}(?:<(?:or|and|with)>{one})*{_pattern(after)}", one, "cc-" if which == "cc" else ""))
    return out


#: Steps from the words of a versioned identifier, joined by "-", to its label: (pattern, with group numbers in braces).
LABEL_STEPS = (("-?v([0-9])", "-{1}"), ("-([0-9]+)-([0-9]+)", "-{1}.{2}"), (f"-([0-9]+)($|{PLUS}|-o)", "-{1}.0{2}"), (f"{PLUS}(-only|-or-later)?", "-or-later"))


def label_of(hit: Column) -> Column:
    """``<gplv2⁺>``: gpl-2.0-or-later."""
    joined = F.translate(F.replace(hit, F.lit("><"), F.lit("-")), "<>", "")
    label = joined
    for pattern, to in LABEL_STEPS:
        label = F.regexp_replace(label, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return F.when(hit.rlike(f"^{identifiers('versioned')}$") | hit.rlike(f"^{identifiers('cc')}$"), label).otherwise(joined)


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, regular expression) in rule order."""
    parts = [[x.strip() for x in line.split(" | ")] for line in RULES.strip().splitlines()]
    return [(int(priority), label, keyword, _pattern(words)) for priority, label, keyword, words in parts]


def base_pattern() -> str:
    """Where a base phrase's words stand one after the other in a lower-cased text."""
    return "|".join(f"(?:{base_pattern_of(p)})" for p in BASE)


def base_pattern_of(phrase: str) -> str:
    inside = WORD[2:-2]  # what separates words
    return f"(?<![^{inside}])" + f"[{inside}]+".join(phrase.split()) + f"(?![^{inside}])"


def words(text: Column) -> Column:
    """Splitting at what is no word is several times as fast in Java's engine as matching WORD, whose class is negated."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def detections(canonical: str) -> Column:
    """Unsuppressed and suppressed detections of the canonical text in a column: array<struct<start, end, priority, rule, label>>, sorted.

    Each rule is an expression of its own with a literal pattern, which Java compiles once: its matches and what stands between
    them, null where its keyword or the pattern is missing. What matched is then walked for word positions.
    """
    hit = "IF(contains({c}, '<{k}>') AND {c} RLIKE r'{x}', named_struct('priority', {p}, 'rule', {i}, 'label', '{label}', 'got', regexp_extract_all({c}, r'{x}', 0), 'between', split({c}, r'{x}', -1)), NULL)"
    hits = F.array_compact(F.array(*[F.expr(hit.format(c=canonical, k=k, x=x, p=p, i=i, label=label)) for i, (p, label, k, x) in enumerate(rules())]))
    span = lambda start, end, p, rule, label: F.struct(start.alias("start"), (-end).alias("minus_end"), p.alias("priority"), rule.alias("rule"), label.alias("label"))
    found = F.flatten(F.transform(hits, lambda r: F.transform(places(r["got"], r["between"]), lambda x: span(x["s"], x["e"], r["priority"], r["rule"], r["label"]))))
    c = F.col(canonical)
    named = [
        F.when(F.contains(c, F.lit(keyword)) & c.rlike(pattern), named_in(c, pattern, one, lambda s, e, hit, p=p, i=i, start=start: span(s, e, F.lit(p), F.lit(i), F.concat(F.lit(start), label_of(hit)))))
        for i, p, keyword, pattern, one, start in contexts()
    ]
    return F.array_sort(F.concat(found, F.flatten(F.array_compact(F.array(*named)))))


def places(got: Column, between: Column) -> Column:
    """Word intervals of matches, from them and what stands between them: array<struct<s, e, hit>>."""
    n_words = lambda s: F.length(s) - F.length(F.replace(s, F.lit("<"), F.lit("")))
    return F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(got)).alias("before"), got.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,hit:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + n_words(x["before"]) + n_words(x["hit"])).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + n_words(x["before"])).alias("s"), (a["at"] + n_words(x["before"]) + n_words(x["hit"])).alias("e"), x["hit"].alias("hit"))).alias("out"),
        ),
    )["out"]


def named_in(c: Column, pattern: str, one: str, span: Callable[[Column, Column, Column], Column]) -> Column:
    """span(start, end, identifier) of every identifier in the expressions that match the pattern."""
    matches = lambda x, p: places(F.regexp_extract_all(x, F.lit(p), F.lit(0)), F.split(x, p, -1))
    return F.flatten(F.transform(matches(c, pattern), lambda m: F.transform(matches(m["hit"], one), lambda x: span(m["s"] + x["s"], m["s"] + x["e"], x["hit"]))))


def unsuppressed(found: Column) -> Column:
    """The detections that no earlier one of the same or a higher priority contains; `found` is sorted by start, then longest first."""
    levels = range(len(CONFIDENCE))
    state = F.struct(*[F.lit(-1).alias(f"end{p}") for p in levels], F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        end = -x["minus_end"]
        reach = F.greatest(*[F.when(x["priority"] >= p, a[f"end{p}"]).otherwise(-1) for p in levels])
        ends = [F.when(x["priority"] == p, F.greatest(a[f"end{p}"], end)).otherwise(a[f"end{p}"]).alias(f"end{p}") for p in levels]
        row = F.struct(x["start"].alias("start"), end.alias("end"), x["priority"].alias("priority"), x["rule"].alias("rule"), x["label"].alias("label"))
        return F.struct(*ends, F.when(reach >= end, a["kept"]).otherwise(F.array_append(a["kept"], row)).alias("kept"))

    return F.aggregate(found, state, step)["kept"]


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (the columns of docs) with n_words, the base scan (n_base, first_word, last_word, base_labels) and license_detections.

    license_detections holds the unsuppressed detections (word interval, priority, rule number, label).
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower())
    base, any_before = base_pattern(), "(?s)^(.*{lazy})(?:" + base_pattern() + ")"
    cc_by = F.contains(F.col("_low"), F.lit("cc")) & F.col("_low").rlike(base_pattern_of("cc by"))
    gate = cc_by
    for g in GATE:
        gate = gate | F.contains(F.col("_low"), F.lit(g))
    is_base = F.contains(F.col("_low"), F.lit("license")) | cc_by
    words_before = lambda lazy: F.size(words(F.regexp_extract("_low", any_before.replace("{lazy}", lazy), 1))).cast("long")
    out = docs.select(nested(docs).alias("row"), low.alias("_low"))
    out = out.withColumn("_n", F.when(is_base, F.regexp_count("_low", F.lit(base))).otherwise(0)).withColumn(
        "_canonical", F.when(gate, F.concat(F.lit("<"), F.array_join(words(F.regexp_replace("_low", PLUS_AT, f"$1{PLUS}$2")), "><"), F.lit(">")))
    )
    out = out.withColumn("_found", F.when(F.col("_canonical").isNotNull(), detections("_canonical")))
    return out.select(
        "row",
        F.size(words(F.col("_low"))).cast("long").alias("n_words"),
        F.col("_n").cast("long").alias("n_base"),
        F.when(F.col("_n") > 0, words_before("?")).alias("first_word"),
        F.when(F.col("_n") > 0, words_before("")).alias("last_word"),
        F.array_sort(F.when(F.col("_n") > 0, F.filter(F.array(*[F.when(F.col("_low").rlike(base_pattern_of(p)), F.lit(label)) for p, label in BASE.items()]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))).alias("base_labels"),
        F.coalesce(unsuppressed(F.col("_found")), F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>")).alias("license_detections"),
    )


def license_report(docs: DataFrame) -> DataFrame:
    """The digest of scan_licenses: one row per document."""
    confidence = F.array_max(F.transform("license_detections", lambda d: F.element_at(F.array(*map(F.lit, CONFIDENCE)), d["priority"] + 1)))
    return scan_licenses(docs).select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.array_distinct(F.col("license_detections.label")))), ",").alias("labels"),
        F.coalesce(confidence, F.when(F.col("n_base") > 0, F.lit(0.9)), F.lit(0.0)).alias("score"),
        F.size("license_detections").cast("long").alias("n_detections"),
    )


def oracle() -> str:
    """license_report in SQL, by joining documents with the rules and comparing their detections pairwise."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({i}, {p}, {quote(label)}, {quote(f'<{k}>')}, {quote(x)})" for i, (p, label, k, x) in enumerate(rules()))
    phrases = {label: "".join(f"<{w}>" for w in p.split()) for p, label in BASE.items()}
    base, upper = quote("|".join(phrases.values())), UPPER
    count = lambda s: f"(length({s}) - length(replace({s}, '<', '')))"
    labels = ", ".join(f"CASE WHEN contains(c, {quote(p)}) THEN {quote(label)} END" for label, p in phrases.items())
    confidence = "[" + ", ".join(map(str, CONFIDENCE)) + "]"
    named = ", ".join(f"({i}, {p}, {quote(k)}, {quote(x)}, {quote(one)}, {quote(start)})" for i, p, k, x, one, start in contexts())
    joined = label = "translate(replace(hh[j], '><', '-'), '<>', '')"
    for pattern, to in LABEL_STEPS:
        label = f"regexp_replace({label}, {quote(pattern)}, {quote(to.format(0, *(chr(92) + g for g in '12')))})"
    versioned = " OR ".join(f"regexp_full_match(hh[j], {quote(identifiers(w))})" for w in ("versioned", "cc"))
    return f"""
    WITH named(rule, priority, keyword, pattern, one, start) AS (VALUES {named}),
    rules(rule, priority, label, keyword, pattern) AS (VALUES {table}),
    w AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS low FROM documents),
    ww AS (SELECT rid, doc_id, regexp_extract_all(regexp_replace(low, {quote(PLUS_AT)}, '\\1{PLUS}\\2', 'g'), {quote(WORD)}) AS words, len(regexp_extract_all(low, {quote(WORD)})) AS n_words FROM w),
    d AS (SELECT rid, doc_id, n_words, CASE WHEN len(words) > 0 THEN '<' || array_to_string(words, '><') || '>' ELSE '' END AS c FROM ww),
    b AS (SELECT *, string_split_regex(c, {base}) AS between, regexp_extract_all(c, {base}) AS hits, list_filter([{labels}], lambda x: x IS NOT NULL) AS base_labels FROM d),
    found AS (
      SELECT rid, rule, priority, label, unnest(range(1, len(h) + 1)) AS k, h, s
      FROM (SELECT rid, rule, priority, label, regexp_extract_all(c, pattern) AS h, string_split_regex(c, pattern) AS s FROM d JOIN rules ON contains(c, keyword))),
    spans AS (
      SELECT rid, rule, priority, label, {count("array_to_string(s[1:k], '') || array_to_string(h[1:k - 1], '')")} AS a,
             {count("array_to_string(s[1:k], '') || array_to_string(h[1:k], '')")} AS e FROM found
      UNION ALL
      SELECT rid, rule, priority, start || CASE WHEN {versioned} THEN {label} ELSE {joined} END,
             base_at + {count("array_to_string(ss[1:j], '') || array_to_string(hh[1:j - 1], '')")}, base_at + {count("array_to_string(ss[1:j], '') || array_to_string(hh[1:j], '')")}
      FROM (SELECT *, unnest(range(1, len(hh) + 1)) AS j FROM (
        SELECT rid, rule, priority, start, {count("array_to_string(s[1:k], '') || array_to_string(h[1:k - 1], '')")} AS base_at, regexp_extract_all(h[k], one) AS hh, string_split_regex(h[k], one) AS ss
        FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM (SELECT rid, rule, priority, start, one, regexp_extract_all(c, pattern) AS h, string_split_regex(c, pattern) AS s FROM d JOIN named ON contains(c, keyword)))))),
    kept AS (
      SELECT x.* FROM spans x WHERE NOT EXISTS (
        SELECT 1 FROM spans y WHERE y.rid = x.rid AND y.priority <= x.priority AND y.a <= x.a AND y.e >= x.e AND (y.a, -y.e, y.priority, y.rule) < (x.a, -x.e, x.priority, x.rule))),
    per AS (SELECT rid, list(DISTINCT label) AS found_labels, max({confidence}[priority + 1]) AS confidence, count(*) AS n FROM kept GROUP BY rid)
    SELECT doc_id, n_words, len(hits) AS n_base, CASE WHEN len(hits) > 0 THEN {count("between[1]")} END AS first_word,
           CASE WHEN len(hits) > 0 THEN {count("array_to_string(between[1:len(hits)], '') || array_to_string(hits[1:len(hits) - 1], '')")} END AS last_word,
           array_to_string(list_sort(list_distinct(base_labels)), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(base_labels, coalesce(found_labels, [])))), ',') AS labels,
           CAST(coalesce(confidence, CASE WHEN len(hits) > 0 THEN 0.9 END, 0.0) AS DOUBLE) AS score, coalesce(n, 0) AS n_detections
    FROM b LEFT JOIN per USING (rid)"""
