"""Secret scans over a trigram inverted index, in DataFrame operations only.

1. `trigram_query` derives from each rule's pattern the Boolean query over
   trigrams that every match satisfies (index and query are in lower case).
2. `postings` has a row for each document and each trigram that some query
   asks for; other trigrams are never looked up, so they are not stored.
3. Postings of a document meet again by its id, and the queries are evaluated
   on them: these (document, rule) pairs are the candidates.
4. Candidates are verified by the pattern itself; a rule whose pattern has no
   mandatory trigram (runs of hexadecimal digits) is tried on every text.

Spans are code points, end exclusive, leftmost and non-overlapping per kind.
Defined cases: a null text is empty; a document without a match has no spans; a text of any
length is searched as a whole, in time about linear in its length and matches;
repeated rows (the same id again) and rows with a null id are scanned each; other
columns are ignored.
"""

from __future__ import annotations

import re._parser as pattern_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import table, whole_text, written


@dataclass(frozen=True)
class Rule:
    """`pattern` is tried leftmost and non-overlapping; a match counts if `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
BASE = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Spans beyond the base ones; public formats of tokens and key files.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + MORE
MOST_STRINGS = 64  # alternatives that a run of known characters may have before it is cut


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All clauses must hold; a clause holds if all trigrams of one of its alternatives occur. No clause: scan fully."""
    clauses: list[list[frozenset[str]]] = []

    def known(items) -> list[str] | None:
        """The strings (lower case) that a sequence matches, if they are few and all known."""
        found = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                own = [chr(arg).lower()]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                own = sorted({chr(a).lower() for _, a in arg})
            elif name == "SUBPATTERN":
                own = known(arg[3])
            elif name == "BRANCH":
                each = [known(x) for x in arg[1]]
                own = None if None in each else sorted({s for x in each for s in x})
            elif name == "MAX_REPEAT" and arg[1] <= 3:
                one = known(arg[2])
                own = None if one is None else sorted({"".join(t) for n in range(arg[0], arg[1] + 1) for t in product(one, repeat=n)})
            else:
                own = None
            if own is None or len(own) * len(found) > MOST_STRINGS:
                return None
            found = [a + b for a in found for b in own]
        return found

    def flush(run: list[str]) -> None:
        if all(len(s) >= 3 for s in run):
            each = {trigrams(s) for s in run}
            clauses.append([t for t in each if not any(other < t for other in each)])  # what another alternative implies adds nothing

    run = [""]
    for item in pattern_parser.parse(pattern):
        own = known([item])
        if own is None or len(own) * len(run) > MOST_STRINGS:
            flush(run)
            run = own if own is not None else [""]
        else:
            run = [a + b for a in run for b in own]
    flush(run)
    return clauses


def query_trigrams(rules=RULES) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for other in clause for t in other})


def postings(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key): the inverted index, of the trigrams that the rules' queries name."""
    lower = docs.select(key, F.lower(whole_text(text)).alias("_lower"))
    found = F.array_compact(F.array(*[F.when(F.contains("_lower", F.lit(t)), F.lit(t)) for t in query_trigrams(rules)]))
    return lower.select(key, F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules=RULES, key: str = "doc_id") -> DataFrame:
    """(key, rules array<string>): the documents whose postings satisfy a rule's query."""
    held = index.groupBy(key).agg(F.collect_set("trigram").alias("_held"))  # at most as many as the queries name

    def holds(rule: Rule) -> Column:
        test = F.lit(True)
        for clause in trigram_query(rule.pattern):
            any_of = F.lit(False)
            for other in clause:
                any_of = any_of | (F.size(F.array_except(F.array(*map(F.lit, sorted(other))), "_held")) == 0)
            test = test & any_of
        return test

    able = [r for r in rules if trigram_query(r.pattern)]
    kinds = F.array_compact(F.array(*[F.when(holds(r), F.lit(r.kind)) for r in able]))
    return held.select(key, kinds.alias("_kinds")).filter(F.size("_kinds") > 0)


#: Numbers that are summed one by one; running sums of more are put together from as many sums.
SUMMED = 256


def running(xs: Column, start: Column) -> Column:
    """Running sums of a short array of integers."""
    first = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(xs, first, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all")), lambda acc: acc["all"])


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is used and in whatever functions of elements."""
    return F.transform(F.array(value), use)[0]


def running_sums(xs: Column) -> Column:
    """Running sums of an array of integers of any length, in blocks: each array that grows number by number stays short."""

    def cut(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / SUMMED).cast("int")
        return F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * SUMMED + 1, F.lit(SUMMED)))).otherwise(F.array().cast("array<array<int>>"))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0)), running(sums, F.lit(0)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, start: running(b, start)))

    return bound(bound(xs, cut), joined)


def spans_of(text: str, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of one rule: lengths of the pieces between matches give the places, in time linear in the text but for the sums of blocks."""
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x))
    found, told = (F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)), lambda x: F.char_length(x)) for g in (0, rule.group))
    own = F.zip_with(found, told, lambda a, b: F.struct(a.alias("own"), b.alias("told")))
    widths = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), found, lambda a, b: a + b)

    def span(end: Column, x: Column) -> Column:
        return F.struct((end - x["own"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), x["told"].alias("told"))

    kept = F.filter(F.zip_with(running_sums(widths), own, span), lambda s: s["told"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))


#: Candidates up to this number are broadcast (ids and a few kinds: under 100 bytes each); more join by shuffle.
BROADCAST_CANDIDATES = 100_000


def find_secrets(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<start, rank, kind, end>>) for every row of `docs`, by start and then by rule."""
    chosen = written(candidates(postings(docs, rules, key, text), rules, key))  # the index is built once, for the count and the join
    few = chosen.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES
    chosen = chosen.withColumnRenamed(key, "_held_by")  # rows with a null id share their postings; the patterns verify each
    rows = docs.select(key, whole_text(text).alias("_text")).join(F.broadcast(chosen) if few else chosen, F.col(key).eqNullSafe(F.col("_held_by")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    each = []
    for rank, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            test = F.array_contains("_kinds", rule.kind)
        else:
            test = F.col("_text").rlike(f"{rule.pattern[:-1]}{{{rule.least}}}" if rule.pattern.endswith("]+") else rule.pattern)
        each.append(F.when(test, spans_of("_text", rule, rank)).otherwise(none))
    return rows.select(key, F.array_sort(F.concat(*each)).alias("spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def lists_sql(rule: Rule) -> str:
    """Lengths of the pieces between a rule's matches, of the matches and of what counts of them."""
    pattern = ("[0-9a-f]{32,}" if rule.kind == "hex" else rule.pattern).replace("'", "''")  # runs are maximal, so shorter ones may be left out at once
    lengths = lambda x: f"list_transform({x}, lambda x: length(x))"
    return ", ".join(f"{x} AS {rule.kind}_{n}" for n, x in (("gap", lengths(f"string_split_regex(t, '{pattern}')")), ("own", lengths(f"regexp_extract_all(t, '{pattern}', 0)")), ("told", lengths(f"regexp_extract_all(t, '{pattern}', {rule.group})"))))


def spans_sql(rule: Rule, rank: int) -> str:
    k = rule.kind
    begin = f"CAST(list_sum({k}_gap[1:i]) + coalesce(list_sum({k}_own[1:i - 1]), 0) AS BIGINT)"
    return f"""list_filter(list_transform(range(1, len({k}_own) + 1), lambda i: {{'start': {begin}, 'rank': {rank}, 'kind': '{k}', 'end': {begin} + {k}_own[i], 'told': {k}_told[i]}}), lambda s: s.told >= {rule.least})"""


def told_sql(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda s: s.kind || ':' || s.start || ':' || s.end), ','), '')"


SQL = {
    "op7_secrets": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS MATERIALIZED (SELECT doc_id, {", ".join(map(lists_sql, RULES))} FROM d),
    b AS MATERIALIZED (SELECT doc_id, {" || ".join(spans_sql(r, n) for n, r in enumerate(BASE))} AS base, {" || ".join(spans_sql(r, len(BASE) + n) for n, r in enumerate(MORE))} AS more FROM m)
    SELECT doc_id, len(list_filter(base, lambda s: s.kind = 'assign')) AS n_assign, len(list_filter(base, lambda s: s.kind = 'access')) AS n_access, len(list_filter(base, lambda s: s.kind = 'hex')) AS n_hex,
        sha256({told_sql("base")}) AS base_sha256, {told_sql("base || more")} AS spans FROM b"""
}
