"""A path for each accepted partial diff that names none: an index of the contentful lines of live files, scores from it, and a ladder of rungs.

Relations: `lines` (session_id, item, side, line) are what a diff adds ('+') and removes ('-'); `hints` (session_id,
hint_id, path, original_lines) are inline diffs that name a path; `paths` (session_id, path, kind) are those of
checkpoints, strong and weak hints; `originals` (session_id, path, content) are earlier texts of files; `seen`
(session_id, path) have their changes from elsewhere already; `files` (repo_root, path, content) are the files of
repositories. A path without a repository is of none.

Each item's candidates carry the rung that they qualify for, and the first rung with one candidate decides. The rungs
are: the only inline hint; the inline hint ahead of all others with more than a weak sign; the only checkpoint or
strong path; the only path of inline hints; the only weak path, if there are no stronger ones; and the best path by
content. An item with candidates that no rung tells apart is an error; one without lines or candidates is neither.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.columns import basename
from agentlens.functions.hashing import line_hash, lines_of
from agentlens.operators.tables import written
from agentlens.sources.store_changes import PLANS, RANK, confident_paths

ITEM = ["session_id", "item"]
LEAST_CHARS, MOST_BYTES = 3, 512 * 1024
# fixed values: folders whose files aren't indexed
SKIPPED = (".git", "node_modules", "target", "dist", "build", ".next", ".venv", "coverage")
CONTENT_RUNG = 5


def contentful(line: Column) -> Column:
    """Whether a line says enough to tell files apart."""
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return (F.octet_length(bare) >= LEAST_CHARS) & bare.rlike(r"[\p{L}\p{N}]")


def counted(rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, line_hash, count) of contentful lines."""
    return rows.filter(contentful(F.col(line))).groupBy(*keys, line_hash(F.col(line)).alias("line_hash")).agg(F.count("*").alias("count"))


def content_index(files: DataFrame) -> DataFrame:
    """The inverted index (repo_root, line_hash, path, count) of files that are not too large nor in a skipped folder."""
    steps = F.split(F.substr("path", F.char_length("repo_root") + 1), "/")
    folders = F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0)))
    small = files.filter((F.octet_length("content") <= MOST_BYTES) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))))
    lines = small.select("repo_root", "path", F.explode(lines_of(F.col("content"))).alias("line"))
    return counted(lines, ["repo_root", "path"]).select("repo_root", "line_hash", "path", "count")


def prefixes(path: Column) -> Column:
    """A path's beginnings, each of whole steps, the path itself last."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))


def repository_of(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """(path, repo_root): the longest root that a path lies in; an equi-join, as each beginning of a path is a key."""
    each = paths.select("path").distinct().select("path", F.explode(prefixes(F.col("path"))).alias("repo_root"))
    return each.join(repos.select("repo_root").distinct(), "repo_root").groupBy("path").agg(F.max_by("repo_root", F.char_length("repo_root")).alias("repo_root"))


def shared(left: DataFrame, right: DataFrame, on: list[str], keys: list[str], name: str) -> DataFrame:
    """(keys, name): the size of the intersection of two multisets of lines."""
    both = left.join(right.withColumnRenamed("count", "_count"), on)
    return both.groupBy(*keys).agg(F.sum(F.least("count", "_count")).alias(name))


def found_by_lines(added: DataFrame, index: DataFrame, known: DataFrame, earlier: DataFrame) -> DataFrame:
    """(ITEM, repo_root, path): paths that share an added line with an item and can win or contest the best place.

    A path that only shares the commonest lines of an item, which sum to `rest`, has at most so many in common. So the
    rarest lines are looked up first; where two paths have more than `rest` in common, no other can matter, and common
    lines (those that a hundred thousand files share) join no file. Only the other items' lines are looked up in full.
    `known` are the paths that an item's session names; `earlier` (session_id, path) are those of earlier texts, which
    can be ahead with few lines in common and are looked up by path and line.
    """
    files = index.groupBy("repo_root", "line_hash").agg(F.count("*").alias("_files"))
    held = added.join(files, ["repo_root", "line_hash"])
    order = Window.partitionBy(*ITEM).orderBy("_files", "line_hash")
    ranked = held.withColumn("_until", F.sum("count").over(order)).withColumn("_all", F.sum("count").over(Window.partitionBy(*ITEM)))
    ranked = written(ranked.withColumn("_rare", F.col("_until") - F.col("count") < F.col("_all") / 2))
    on = ["repo_root", "line_hash"]
    postings = index.withColumnRenamed("count", "_count")
    rare = ranked.filter("_rare").join(postings, on)
    rest = ranked.groupBy(*ITEM).agg(F.sum(F.when(~F.col("_rare"), F.col("count")).otherwise(0)).alias("_rest"))
    first = written(rare.groupBy(*ITEM, "repo_root", "path").agg(F.sum(F.least("count", "_count")).alias("_got")))
    second = F.get(F.sort_array(F.collect_list("_got"), asc=False), F.lit(1))
    top = Window.partitionBy(*ITEM).orderBy(F.desc("_got"), "path")
    ahead = first.withColumn("_place", F.row_number().over(top)).filter("_place <= 2").groupBy(*ITEM).agg(second.alias("_second"))
    open_ = written(rest.join(ahead, ITEM, "left").filter((F.col("_rest") > 0) & (F.coalesce("_second", F.lit(0)) <= F.col("_rest"))).select(*ITEM))
    full = ranked.filter("NOT _rare").join(open_, ITEM, "left_semi").join(postings, on).select(*ITEM, "repo_root", "path")
    old = added.join(earlier.distinct(), "session_id").join(index.drop("count"), ["repo_root", "path", "line_hash"], "left_semi").select(*ITEM, "repo_root", "path")
    return first.select(*ITEM, "repo_root", "path").unionByName(full).unionByName(old).unionByName(known.select(*ITEM, "repo_root", "path")).distinct()


def content_ranks(lines: DataFrame, named: DataFrame, hints: DataFrame, paths: DataFrame, originals: DataFrame, index: DataFrame) -> DataFrame:
    """(ITEM, path, *RANK): the eight parts of each candidate's rank, from the index and what the sessions name.

    `named` are (ITEM, repo_root, path): the paths that each item's session names, with the repository that is looked into.
    """
    repos = named.select(*ITEM, "repo_root").distinct()
    own = written(counted(lines, [*ITEM, "side"]).join(repos, ITEM))
    added, removed = (own.filter(F.col("side") == s).drop("side") for s in "+-")
    earlier = hints.select("session_id", "path").unionByName(originals.select("session_id", "path"))
    candidates = written(found_by_lines(added, index, named, earlier))
    key, line = [*ITEM, "path"], ["repo_root", "path", "line_hash"]
    live = [shared(part.join(candidates, [*ITEM, "repo_root"]), index, line, key, name) for part, name in ((added, "live_added"), (removed, "live_removed"))]
    hinted = counted(hints.select("session_id", "hint_id", "path", F.explode("original_lines").alias("line")), ["session_id", "hint_id", "path"])
    before = counted(originals.select("session_id", "path", F.explode(lines_of(F.col("content"))).alias("line")), ["session_id", "path"]).withColumn("hint_id", F.lit(None).cast(hints.schema["hint_id"].dataType))
    texts = hinted.unionByName(before).withColumnRenamed("path", "_path")
    gone = shared(removed, texts, ["session_id", "line_hash"], [*ITEM, "_path", "hint_id"], "_n").groupBy(*ITEM, F.col("_path").alias("path")).agg(F.max("_n").alias("historical_removed"))
    flags = paths.groupBy("session_id", "path").agg(*[F.max((F.col("kind") == kind).cast("int")).alias(name) for kind, name in (("checkpoint", "checkpoint"), ("strong", "strong_hint"), ("weak", "weak_hint"))])
    # names and beginnings that another named path of the item has
    mine = named.select(*ITEM, "path", F.lit(1).alias("_own"))
    placed = candidates.join(mine, key, "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    names = named.groupBy(*ITEM, basename(F.col("path")).alias("_name")).agg(F.count("*").alias("_n"))
    same = placed.withColumn("_name", basename(F.col("path"))).join(names, [*ITEM, "_name"]).filter("_n > _own").select(*key, F.lit(1).alias("basename"))
    steps = lambda df: df.select(*ITEM, "path", *[c for c in ("_own",) if c in df.columns], F.posexplode(prefixes(F.substr("path", F.char_length("repo_root") + 2))).alias("_depth", "_step"))
    inside = lambda df: df.filter(F.startswith("path", F.concat("repo_root", F.lit("/"))))
    taken = steps(inside(named)).groupBy(*ITEM, "_step").agg(F.count("*").alias("_n"))
    near = steps(inside(placed)).join(taken, [*ITEM, "_step"]).filter("_n > _own").groupBy(*key).agg((F.max("_depth") + 1).alias("proximity"))
    joined = reduce(lambda df, part: df.join(part, key, "left"), [gone, *live, same, near], candidates).join(flags, ["session_id", "path"], "left")
    return joined.select(*key, *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in RANK])


def one_of(candidates: DataFrame, rung: int) -> DataFrame:
    """(ITEM, path, rung) of the items with one path among the candidates."""
    return candidates.groupBy(*ITEM).agg(F.count_distinct("path").alias("_n"), F.min("path").alias("path")).filter("_n = 1").select(*ITEM, "path", F.lit(rung).alias("rung"))


def resolved(lines: DataFrame, hints: DataFrame, paths: DataFrame, originals: DataFrame, seen: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ITEM, path, rung) of the items that a rung decides, and (ITEM, error) of those that none does."""
    items = written(lines.select(*ITEM).distinct())
    fresh = lambda df: df.join(seen.select("session_id", "path").distinct(), ["session_id", "path"], "left_anti")
    inline, known = written(fresh(hints)), written(fresh(paths))
    each = items.join(inline.drop("original_lines"), "session_id")
    removed = lines.filter("side = '-'")
    # how many removed lines of an item a hint's text has, and whether both have none
    texts = inline.select("session_id", "hint_id", F.explode("original_lines").alias("line")).distinct()
    overlap = removed.join(texts, ["session_id", "line"]).groupBy(*ITEM, "hint_id").agg(F.count("*").alias("overlap"))
    only_adds = items.join(removed.select(*ITEM).distinct(), ITEM, "left_anti").withColumn("_adds", F.lit(1))
    empty = inline.filter(F.size("original_lines") == 0).select("session_id", "hint_id", F.lit(1).alias("_empty"))
    flags = paths.groupBy("session_id", "path").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("checkpoint", "strong", "weak")])
    told = each.join(overlap, [*ITEM, "hint_id"], "left").join(only_adds, ITEM, "left").join(empty, ["session_id", "hint_id"], "left").join(flags, ["session_id", "path"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = F.struct(zero("overlap").alias("overlap"), (zero("_adds") * zero("_empty")).alias("new"), zero("checkpoint").alias("checkpoint"), zero("strong").alias("strong"), zero("weak").alias("weak"))
    scored = written(told.select(*ITEM, "hint_id", "path", score.alias("score")))
    n_hints = scored.groupBy(*ITEM).agg(F.count("*").alias("_n"), F.min("path").alias("path"), F.max("score").alias("_best"))
    rungs = [n_hints.filter("_n = 1").select(*ITEM, "path", F.lit(0).alias("rung"))]
    best = scored.join(n_hints.select(*ITEM, "_best"), ITEM).filter("score = _best").groupBy(*ITEM, "score").agg(F.count("*").alias("_n"), F.min("path").alias("path"))
    rungs.append(best.filter("_n = 1 AND score.overlap + score.new + score.checkpoint + score.strong > 0").select(*ITEM, "path", F.lit(1).alias("rung")))
    firm = known.filter(F.col("kind").isin("checkpoint", "strong"))
    weak = known.filter("kind = 'weak'")
    rungs.append(one_of(items.join(firm, "session_id"), 2))
    rungs.append(one_of(scored, 3))
    rungs.append(one_of(items.join(weak.join(firm.select("session_id").distinct(), "session_id", "left_anti"), "session_id"), 4))
    decided = reduce(DataFrame.unionByName, rungs).groupBy(*ITEM).agg(F.min_by("path", "rung").alias("path"), F.min("rung").alias("rung"))
    decided = written(decided)
    open_ = written(items.join(decided.select(*ITEM), ITEM, "left_anti"))
    ranked, named = by_content(lines.join(open_, ITEM, "left_semi"), open_, scored, known, hints, paths, originals, files)
    told_paths = confident_paths(ranked).withColumn("rung", F.lit(CONTENT_RUNG))
    found = decided.unionByName(told_paths)
    errors = named.groupBy(*ITEM).agg(F.count_distinct("path").alias("_n")).join(told_paths, ITEM, "left_anti")
    return found, errors.select(*ITEM, F.concat(F.lit("ambiguous partial diff: "), F.col("_n").cast("string"), F.lit(" paths are named")).alias("error"))


def by_content(lines: DataFrame, items: DataFrame, scored: DataFrame, known: DataFrame, hints: DataFrame, paths: DataFrame, originals: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranks of the items' candidates, and (ITEM, path) of the paths that are named for an item: of inline hints with lines in common, else all."""
    some = scored.join(items, ITEM, "left_semi")
    close = some.filter("score.overlap > 0 OR score.new > 0").select(*ITEM, "path")
    every = some.select(*ITEM, "path").unionByName(items.join(known.select("session_id", "path"), "session_id").select(*ITEM, "path")).filter(~F.contains("path", F.lit(PLANS)))
    named = written(close.unionByName(every.join(close.select(*ITEM).distinct(), ITEM, "left_anti")).distinct())
    # all that the session names must lie in one repository
    session_paths = hints.select("session_id", "path").unionByName(paths.select("session_id", "path")).distinct()
    roots = session_paths.join(repository_of(session_paths, files), "path")
    one = roots.groupBy("session_id").agg(F.count_distinct("repo_root").alias("_n"), F.min("repo_root").alias("repo_root")).filter("_n = 1").drop("_n")
    return content_ranks(lines, named.join(one, "session_id"), hints, paths, originals, written(content_index(files))), named
