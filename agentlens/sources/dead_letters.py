"""What parsers could not read, as rows: (source_file, line_no, call_id, parser, error).

Each parser reads a text once, into a struct of what it found and of what is wrong with it; the struct is written, and rows
and errors are two projections of that table. So nothing is parsed twice, and neither can say something else than the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.operators.tables import written

COLUMNS = ("source_file", "line_no", "call_id", "parser", "error")
#: `cat > path << marker`: mode, path by kind of quotes, marker by kind of quotes.
HEAD = r"""(?<![^\s&|;])cat\s+(>>?)\s*(?:"([^"]*)"|'([^']*)'|([^\s<"'][^\s<]*))\s*<<\s*(?:"([^"]*)"|'([^']*)'|([^\s"']\S*))"""
#: The body up to a line that is the marker, or, where there is none, all of the rest.
DOCUMENT = HEAD + r"(?:[^\n]*\n([\s\S]*?)(?<=\n)(\5|\6|\7)\r?(?=\n|\z)|[\s\S]*)"
#: Headers that end too early, with what is said of each.
BROKEN = (
    (r"""(?<![^\s&|;])cat\s+>>?\s*(?:"[^"]*|'[^']*)\z""", "unterminated quoted path in heredoc command"),
    (r"""(?<![^\s&|;])cat\s+>>?\s*(?:"[^"]*"|'[^']*'|[^\s<"'][^\s<]*)\s*<<\s*\z""", "missing heredoc marker"),
    (r"""(?<![^\s&|;])cat\s+>>?\s*(?:"[^"]*"|'[^']*'|[^\s<"'][^\s<]*)\s*<<\s*(?:"[^"]*|'[^']*)\z""", "unterminated quoted heredoc marker"),
)


def letters(rows: DataFrame, parser: str, error: Column | str = "error") -> DataFrame:
    """`rows` with an error in the common form; what a parser doesn't know of a row's place is null."""
    kinds = {"source_file": "string", "line_no": "bigint", "call_id": "string"}
    have = lambda c: F.col(c).cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c])
    told = rows.select(*[have(c).alias(c) for c in kinds], F.lit(parser).alias("parser"), (F.col(error) if isinstance(error, str) else error).alias("error"))
    return told.filter(F.col("error").isNotNull())


def dead_letters(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).select(*COLUMNS)


def record_errors(lines: DataFrame, parser: str) -> DataFrame:
    """Log lines that are no JSON object."""
    read = F.try_parse_json("value")
    wrong = F.when(read.isNull(), "the line is no JSON").when(~F.schema_of_variant(read).startswith("OBJECT"), "the line is no JSON object")
    return letters(lines, parser, wrong)


def first_of(values: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def written_documents(calls: DataFrame, keys: list[str], command: str) -> tuple[DataFrame, DataFrame]:
    """(keys, doc_index, mode, path, content) of the here-documents of shell commands, and (keys, error) of commands that are not read.

    A command with a broken document gives none at all, since what it writes isn't known.
    """
    groups = {"mode": 1, "p1": 2, "p2": 3, "p3": 4, "m1": 5, "m2": 6, "m3": 7, "content": 8, "end": 9}
    found = F.arrays_zip(*[F.regexp_extract_all(command, F.lit(DOCUMENT), F.lit(g)).alias(n) for n, g in groups.items()])
    open_ = F.get(F.filter(found, lambda d: d["end"] == ""), F.lit(0))
    marker = first_of([open_[m] for m in ("m1", "m2", "m3")])
    broken = F.when(open_.isNotNull(), F.concat(F.lit("heredoc terminator '"), marker, F.lit("' not found")))
    # an earlier document's body can look like a header, so headers are looked for after the documents
    rest = F.regexp_replace(command, DOCUMENT, "\n")
    for pattern, said in BROKEN:
        broken = F.coalesce(broken, F.when(rest.rlike(pattern), said))
    read = written(calls.select(*keys, F.struct(found.alias("documents"), broken.alias("error")).alias("_read")))
    docs = read.filter("_read.error IS NULL").select(*keys, F.posexplode("_read.documents").alias("doc_index", "d"))
    mode = F.when(F.col("d.mode") == ">>", "append").otherwise("overwrite")
    told = docs.select(*keys, "doc_index", mode.alias("mode"), first_of([F.col(f"d.{p}") for p in ("p1", "p2", "p3")]).alias("path"), F.col("d.content").alias("content"))
    return told, read.filter("_read.error IS NOT NULL").select(*keys, F.col("_read.error").alias("error"))


HUNK = r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"


def diff_errors(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, error): hunks of unified diffs outside of any file, and hunks with other numbers of lines than they say."""
    lines = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    order = Window.partitionBy(*keys).orderBy("line_no")
    head, hunk = F.startswith("line", F.lit("diff --git ")), F.col("line").rlike(HUNK)
    # each file's header and each hunk opens a block; a hunk's lines end where the next block begins
    placed = lines.withColumns({"_file": F.sum(head.cast("int")).over(order), "_block": F.sum((head | hunk).cast("int")).over(order)})
    wanted = lambda g: F.when(hunk, F.coalesce(F.nullif(F.regexp_extract("line", HUNK, g), F.lit("")), F.lit("1")).cast("int"))
    mark = F.substring("line", 1, 1)
    counted = lambda *marks: F.sum((~hunk & mark.isin(*marks)).cast("int"))
    blocks = placed.groupBy(*keys, "_block").agg(
        F.min(F.when(hunk, F.col("line_no"))).alias("line_no"), F.max("_file").alias("_file"), F.max(wanted(1)).alias("_old"), F.max(wanted(2)).alias("_new"), counted("-", " ").alias("_has_old"), counted("+", " ").alias("_has_new")
    )
    of = lambda name, has: F.concat(F.lit("a hunk says "), F.col(name).cast("string"), F.lit(" lines and has "), F.col(has).cast("string"))
    error = F.when(F.col("_file") == 0, "a hunk outside of any file").when(F.col("_old") != F.col("_has_old"), of("_old", "_has_old")).when(F.col("_new") != F.col("_has_new"), of("_new", "_has_new"))
    return blocks.filter("line_no IS NOT NULL").select(*keys, F.col("line_no").cast("bigint").alias("line_no"), error.alias("error")).filter("error IS NOT NULL")
