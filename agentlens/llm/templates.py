"""Line dedup by a log-template tree.

The tree has a fixed depth: a line goes down by its number of words and then by
its first `DEPTH` words, where a word that holds a digit counts as `<*>`. In the
leaf it reaches, each word of a line has the number of documents with that word at
its place. A line fits if words of `MIN_DOCS` documents or more make up
`CONSTANT_SHARE` of it; the rarest word that this share needs tells how common its
template is. Words that are at least `FIELD_SHARE` times as common are constant,
all others variable fields, so a field's value is none the more constant for having
come up in many documents of a large leaf. A line that fits takes the template with
its fields as wildcards; any other line is its own template. The leaf's words are
counted instead of compared line by line, so the result doesn't depend on the order
of lines, and a hot leaf is an ordinary aggregation.

A line whose words are fields by over half because they hold digits has too little
in common with others and stands for itself, digits and all.

A template recurs if it stands in `MIN_DOCS` documents or more that aren't copies of
each other, so that the body of a document isn't lost for having copies. Copies are
told by their lines' starts (number of words, first `DEPTH` words): two texts are
copies if 100 * common starts >= `COPY_PERCENT` * all their starts. Each text is
compared with the most central text (the one with the largest share of starts that
others have) at each of its rarest starts, of which copies share one; texts that are
linked so, over others too, count once. Lines of recurring templates are dropped from
every document, copies too.

Texts are counted once however many documents have them, and lines are dropped by
text, so ids take no part.

Defined cases: a null text has no lines and stays null; empty lines (or ones of white
space) are kept and make no templates; words are what single spaces part; lines of one
word are lines like others; equal texts count once; rows with a null id, and rows that
repeat an id, are treated like any others; other columns are kept, whatever their names,
but for one named `n_lines_dropped`, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import discarded, table, written
from agentlens.llm.components import components

DEPTH, MIN_DOCS, CONSTANT_SHARE, FIELD_SHARE, COPY_PERCENT = 3, 5, 0.75, 0.5, 75
#: Leaves to look at again up to this number are broadcast (8 bytes each); more join by shuffle.
BROADCAST_LEAVES = 200_000
#: Bits of the bitmap of the texts that lose lines: 16 for each text, and this number (of which 8 MB are broadcast) at most.
MOST_BITS = 1 << 26
FIELD = "<*>"
HOLDS_DIGIT = r"(?<!\S)[^\s0-9]*+[0-9]\S*"


def masked(line: Column) -> Column:
    """The line with its words that hold digits as fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, HOLDS_DIGIT, FIELD)).otherwise(line)


def told(line: Column, words: Column) -> Column:
    """The line as it makes templates: with its fields, unless they are over half of its words."""
    m = masked(line)
    fields = (F.octet_length(m) - F.octet_length(F.replace(m, F.lit(FIELD), F.lit("")))) / len(FIELD)
    return F.when(~line.rlike("[0-9]"), line).when(2 * fields <= words, m).otherwise(line)


def text_names(text: str) -> list[Column]:
    """96 bits that name a text."""
    return [F.xxhash64(text).alias("_text_id"), F.hash(text).alias("_check")]


def line_rows(docs: DataFrame, text: str) -> DataFrame:
    """(_text_id, _check, _at, _line, _words, _leaf): the lines that can have a template; the leaf looks at the line's length and first words only."""
    split = docs.filter(F.col(text).isNotNull()).select(*text_names(text), F.posexplode(F.split(text, "\n")).alias("_at", "_line")).withColumn("_line", F.trim("_line")).filter(F.col("_line").rlike(r"\S"))
    counted = split.withColumn("_words", F.octet_length("_line") - F.octet_length(F.replace("_line", F.lit(" "))) + 1)
    return counted.withColumn("_leaf", F.xxhash64("_words", masked(F.substring_index("_line", " ", DEPTH))))


def recurring(lines: DataFrame, by: str, of: str = "_text_id") -> DataFrame:
    """The keys that occur in `MIN_DOCS` different texts or more."""
    return lines.select(by, of).distinct().groupBy(by).agg(F.count("*").alias("_docs")).filter(F.col("_docs") >= MIN_DOCS)


def generalised(docs: DataFrame, lines: DataFrame, text: str) -> DataFrame:
    """(_line_id, _template): of the lines that have variable fields beside what holds digits."""
    leaves = lines.select("_leaf", "_line_id").distinct().groupBy("_leaf").agg(F.count("*").alias("_n")).filter("_n > 1").join(recurring(lines, "_leaf"), "_leaf").select("_leaf")
    leaves = written(leaves)
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    again = line_rows(docs, text).filter(F.col("_words") > DEPTH).join(F.broadcast(leaves) if few else leaves, "_leaf").select("_leaf", told(F.col("_line"), F.col("_words")).alias("_told"), "_text_id").distinct()
    words = F.split("_told", " ")
    word = again.select("_leaf", F.xxhash64("_told").alias("_line_id"), "_text_id", F.size(words).alias("_n"), F.posexplode(words).alias("_place", "_word")).withColumn("_word", F.xxhash64("_word"))
    # a text counts once for a word and place however many of its lines have it
    often = word.select("_leaf", "_place", "_word", "_text_id").distinct().groupBy("_leaf", "_place", "_word").agg(F.count("*").alias("_docs")).filter(F.col("_docs") >= MIN_DOCS)
    own = word.select("_leaf", "_line_id", "_n", "_place", "_word").distinct().join(often, ["_leaf", "_place", "_word"])
    # from the most common word down; at most as many as the line has words
    line = own.groupBy("_leaf", "_line_id", "_n").agg(F.sort_array(F.collect_list(F.struct("_docs", "_place", "_word")), asc=False).alias("_common"))
    needed = F.ceil(F.lit(CONSTANT_SHARE) * F.col("_n")).cast("int")
    shaped = line.filter(F.size("_common") >= needed).withColumn("_least", F.lit(FIELD_SHARE) * F.element_at("_common", needed)["_docs"])
    shaped = shaped.withColumn("_constants", F.filter("_common", lambda w: w["_docs"] >= F.col("_least"))).filter(F.size("_constants") > DEPTH)
    return shaped.select("_line_id", F.xxhash64("_leaf", F.transform("_constants", lambda w: F.struct(w["_place"], w["_word"]))).alias("_template"))


def copies(lines: DataFrame) -> DataFrame:
    """(_text_id, _body): of the texts that are copies of others but for few lines, with the text that stands for all of them."""
    starts = written(lines.select("_text_id", "_start").distinct())
    often = written(starts.groupBy("_start").agg(F.count("*").alias("df")).filter("df > 1"))
    sizes = starts.groupBy("_text_id").agg(F.count("*").alias("n"))
    shared = starts.join(often, "_start").groupBy("_text_id").agg(F.array_sort(F.collect_list(F.struct("df", "_start"))).alias("shared"))
    first = (F.col("n") - F.ceil(F.col("n") * COPY_PERCENT / 100) + 1 - (F.col("n") - F.size("shared"))).cast("int")
    sets = written(shared.join(sizes, "_text_id").withColumn("take", first).filter("take > 0").select("_text_id", "n", "take", F.transform("shared", lambda x: x["_start"]).alias("shared")))
    entries = sets.select("_text_id", (F.size("shared") / F.col("n")).alias("central"), F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("_start"))
    hubs = written(entries.groupBy("_start").agg(F.max(F.struct("central", "_text_id"))["_text_id"].alias("hub")))
    pairs = written(entries.join(hubs, "_start").filter("_text_id <> hub").select("_text_id", "hub").distinct())
    of_hub = sets.join(pairs.select(F.col("hub").alias("_text_id")).distinct(), "_text_id", "left_semi").select(F.col("_text_id").alias("hub"), F.col("n").alias("n_hub"), F.col("shared").alias("of_hub"))
    both = pairs.join(of_hub, "hub").join(sets.select("_text_id", "n", "shared"), "_text_id").withColumn("common", F.size(F.array_intersect("shared", "of_hub")))
    linked = both.filter(100 * F.col("common") >= COPY_PERCENT * (F.col("n") + F.col("n_hub") - F.col("common")))
    return components(linked.select(F.col("_text_id").alias("a"), F.col("hub").alias("b"))).select(F.col("vertex").alias("_text_id"), F.col("component").alias("_body"))


def dropped_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_text_id, _check, _at): places of the lines whose template recurs, for each distinct text."""
    start = F.xxhash64("_words", F.substring_index("_line", " ", DEPTH)).alias("_start")
    lines = written(line_rows(docs, text).select("_text_id", "_check", "_at", "_leaf", start, F.xxhash64(told(F.col("_line"), F.col("_words"))).alias("_line_id")).distinct())
    shapes = generalised(docs, lines, text)
    placed = written(lines.join(shapes, "_line_id", "left").select("_text_id", "_check", "_at", F.coalesce("_template", "_line_id").alias("_template")))
    # counts are written before they are joined to lines again: both sides of the join then come from their own exchange, and a hot template's lines can be split
    often = written(recurring(placed, "_template").select("_template"))
    found = written(placed.join(often, "_template"))
    bodies = written(copies(lines.join(found.select("_text_id").distinct(), "_text_id", "left_semi")))
    discarded(lines, placed, often)
    independent = found.select("_template", "_text_id").distinct().join(bodies, "_text_id", "left").select("_template", F.coalesce("_body", "_text_id").alias("_body"))
    evident = written(recurring(independent, "_template", "_body").select("_template"))
    return found.join(evident, "_template", "left_semi").select("_text_id", "_check", "_at")


def marked(rows: DataFrame, gone: DataFrame, most_bits: int) -> DataFrame:
    """`rows` with `_some`, which is false only for texts that aren't in `gone`: most texts lose no line and needn't be moved to find out."""
    n_bits = 64
    while n_bits < min(16 * gone.count(), most_bits):
        n_bits *= 2
    place = F.pmod("_text_id", F.lit(n_bits))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(63).cast("int")
    bits = gone.select(word.alias("_word"), F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]), bit + 1).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").withColumn("_some", held).drop("_word", "_bits")  # at most most_bits / 64 rows


def without_templates(docs: DataFrame, text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """`docs` with recurring lines taken out of `text`, and n_lines_dropped."""
    gone = written(dropped_lines(docs.select(text), text).groupBy("_text_id", "_check").agg(F.collect_set("_at").alias("_gone")))
    rows = marked(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "n_lines_dropped"]).alias("_row"), *text_names(text)), gone, most_bits)
    untouched = rows.filter(~F.col("_some")).select("_row", F.lit(None).cast("array<int>").alias("_gone"))
    rows = untouched.unionByName(rows.filter("_some").join(gone, ["_text_id", "_check"], "left").select("_row", "_gone"))
    own = lambda c: F.col("_row").getField(c)
    rest = F.array_join(F.filter(F.split(own(text), "\n"), lambda line, at: ~F.array_contains("_gone", at)), "\n")
    kept = F.when(F.col("_gone").isNull(), own(text)).otherwise(rest)
    return rows.select(*[(kept if c == text else own(c)).alias(c) for c in docs.columns if c != "n_lines_dropped"], F.coalesce(F.size("_gone"), F.lit(0)).alias("n_lines_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines_dropped").cast("bigint").alias("n_lines_dropped"), F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
