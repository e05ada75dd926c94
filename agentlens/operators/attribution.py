"""Attribution of commit lines to sessions by line hashes, with a fallback for renamed files.

Tables: commit rows (repo_root, commit_sha, rel_path, side, line_hash, count) and
session rows (repo_root, provider, session_id, rel_path, side, line_hash, count).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.columns import basename
from agentlens.operators.tables import written

WEAK_RATIO, MIN_RATIO, MIN_LINES, MARGIN = 0.20, 0.80, 30, 0.20
HEAVY_SHARE = 0.5
FILE = ["repo_root", "commit_sha", "rel_path"]
LINE = ["repo_root", "rel_path", "side", "line_hash"]
#: Keys as joins and windows sort them: what differs most comes first, since sorts compare the beginning of the first key before all else.
BY_FILE, BY_LINE, BY_COMMIT = ["commit_sha", "rel_path", "repo_root"], ["line_hash", "rel_path", "repo_root", "side"], ["commit_sha", "repo_root"]


def session_availability(session_rows: DataFrame) -> DataFrame:
    """What each session has of a line: the most that one change of it has."""
    return session_rows.filter(F.col("rel_path").isNotNull()).groupBy(*LINE, "provider", "session_id").agg(F.max("count").alias("avail"))


def provider_availability(session_rows: DataFrame, side: str = "+") -> DataFrame:
    """(repo_root, rel_path, line_hash, avail): the most of each provider, summed over providers."""
    keys = ["repo_root", "rel_path", "line_hash"]
    most = session_rows.filter((F.col("side") == side) & F.col("rel_path").isNotNull()).groupBy(*keys, "provider").agg(F.max("count").alias("m"))
    return most.groupBy(*keys).agg(F.sum("m").alias("avail"))


def path_availability(session_rows: DataFrame) -> DataFrame:
    """The most that any one change has of a line, by path."""
    return session_rows.filter(F.col("rel_path").isNotNull()).groupBy(*LINE).agg(F.max("count").alias("avail"))


def file_rows(commit_rows: DataFrame) -> DataFrame:
    return commit_rows.groupBy(*FILE, "side", "line_hash").agg(F.sum("count").alias("count"))


def confident_pick(ranked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the best candidate of each key, if it is good enough alone and far enough ahead of the next."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "candidate")
    first = ranked.withColumn("_rank", F.row_number().over(order)).withColumn("_next", F.coalesce(F.lead("score").over(order), F.lit(0))).filter("_rank = 1")
    ratio, runner = F.col("score") / F.col("total_lines"), F.col("_next") / F.col("total_lines")
    return first.filter((ratio >= MIN_RATIO) & (F.col("score") >= MIN_LINES) & (ratio - runner >= MARGIN)).select(*keys, F.col("candidate").alias(name))


def alias_candidates(rows: DataFrame, known: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """(keys, candidate): other paths that can hold enough of a file's lines to win or to come near a winner.

    A winner has `MIN_RATIO` of the lines and only a path with over `MIN_RATIO - MARGIN` of them can contest it, so a
    candidate that matters has one of any lines that make up more than the rest. These are the file's rarest ones:
    lines that every path has don't join unless a file consists of them. `rows` have keys (with rel_path), the columns of
    `on`, count and total_lines; `known` are (rel_path, on), each once.
    """
    paths = known.groupBy(*on).agg(F.count("*").alias("_paths"))
    ranked = rows.join(paths, on, "left").withColumn("_paths", F.coalesce("_paths", F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_paths", *on).rowsBetween(Window.unboundedPreceding, -1)
    rare = ranked.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).filter(F.col("_before") <= (1 - MIN_RATIO + MARGIN) * F.col("total_lines"))
    other = known.withColumnRenamed("rel_path", "candidate")
    return rare.filter("_paths > 0").join(other, on).filter(F.col("candidate") != F.col("rel_path")).select(*keys, "candidate").distinct()


def alias_names(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alias) of (keys, total_lines, candidate, score): paths with the file's own name are asked first."""
    same_name = confident_pick(scored.filter(basename(F.col("candidate")) == basename(F.col("rel_path"))), keys, "_same")
    any_name = confident_pick(scored, keys, "_any")
    return any_name.join(same_name, keys, "full").select(*keys, F.coalesce("_same", "_any").alias("alias"))


def line_availability(session_rows: DataFrame) -> DataFrame:
    """(LINE, _total, _most): what all sessions together have of a line, and the most that one of them has. Rows are dealt by line once."""
    return session_availability(session_rows.repartition(*BY_LINE)).groupBy(*LINE).agg(F.sum("avail").alias("_total"), F.max("avail").alias("_most"))


class Matched:
    """Which lines of commits match lines of sessions, under which path. Tables are made when they are first asked for."""

    def __init__(self, commit_rows: DataFrame, session_rows: DataFrame):
        self._commit_rows, self._session_rows = commit_rows, session_rows

    @cached_property
    def availability(self) -> DataFrame:
        """What sessions have (LINE, provider, session_id, avail)."""
        return written(session_availability(self._session_rows))

    @cached_property
    def have(self) -> DataFrame:
        return written(line_availability(self._session_rows))

    @cached_property
    def lines(self) -> DataFrame:
        """Commit lines (FILE, side, line_hash, count), what of them sessions have under the same path (matched, _total), the sums of their file and if that is weak.

        Rows are dealt by line once for the sum and the join, and by file once for the file's sums.
        """
        rows = file_rows(self._commit_rows.repartition(*BY_LINE)).join(self.have.drop("_most"), BY_LINE, "left")
        rows = rows.withColumn("matched", F.when(F.col("_total").isNull(), 0).otherwise(F.least("count", "_total")))
        file = Window.partitionBy(*BY_FILE)
        sums = rows.withColumns({"total_lines": F.sum("count").over(file), "strict_lines": F.sum("matched").over(file)})
        return written(sums.withColumn("_weak", F.coalesce(F.col("strict_lines") / F.col("total_lines") < WEAK_RATIO, F.lit(False))))

    @cached_property
    def _renamed(self) -> tuple[DataFrame, DataFrame]:
        """Lines of weak files as they match under the alias (FILE, side, line_hash, _path, matched, _total), and the files (FILE) that match more by it."""
        weak = self.lines.filter("_weak").select(*FILE, "side", "line_hash", "count", "total_lines", "strict_lines")
        tried = weak.join(alias_candidates(weak, self.have.select(*LINE), BY_FILE, ["line_hash", "repo_root", "side"]), BY_FILE)
        there = tried.join(self.have.withColumnRenamed("rel_path", "candidate"), ["line_hash", "candidate", "repo_root", "side"])
        there = written(there.select(*FILE, "side", "line_hash", "candidate", "total_lines", "strict_lines", F.least("count", "_most").alias("_score"), F.least("count", "_total").alias("matched"), "_total"))
        scored = there.groupBy(*FILE, "total_lines", "candidate").agg(F.sum("_score").alias("score")).filter("score > 0")
        renamed = there.join(alias_names(scored, BY_FILE).withColumnRenamed("alias", "candidate"), [*BY_FILE, "candidate"])
        better = renamed.groupBy(*FILE, "strict_lines").agg(F.sum("matched").alias("_got")).filter(F.col("_got") > F.col("strict_lines")).select(*FILE)
        better = written(better)
        moved = renamed.filter("matched > 0").withColumn("_path", F.col("candidate")).select(*FILE, "side", "line_hash", "_path", "matched", "_total")
        return written(moved.join(better, BY_FILE, "left_semi")), better

    def _chosen(self, strict: DataFrame, moved: DataFrame) -> DataFrame:
        """Rows of strong files and of weak ones that no alias tells better, and those of the others by their alias."""
        kept = lambda weak: strict.filter("_weak" if weak else "NOT _weak").drop("_weak")
        return kept(False).unionByName(kept(True).join(self._renamed[1], BY_FILE, "left_anti")).unionByName(moved)

    @property
    def chosen(self) -> DataFrame:
        """(FILE, side, line_hash, _path, matched, _total): lines that match, under the path that tells most."""
        strict = self.lines.filter("matched > 0").withColumn("_path", F.col("rel_path")).select(*FILE, "side", "line_hash", "_path", "matched", "_total", "_weak")
        return self._chosen(strict, self._renamed[0])

    @property
    def matched_by_file(self) -> DataFrame:
        """(FILE, side, matched): sums of `chosen`."""
        sums = lambda rows, *more: rows.groupBy(*FILE, "side", *more).agg(F.sum("matched").alias("matched"))
        return self._chosen(sums(self.lines, "_weak"), sums(self._renamed[0]))


def line_classes(availability: DataFrame, parts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(LINE, _class) and (_class, provider, session_id, _part): lines of which the same sessions have the same parts are one class.

    Lines that come together, as those of one change or of a file that all sessions copy, meet commits once as a class instead
    of once each. A class is named by two 64-bit sums of its members' hashes and their number, which tasks add up. Without
    `parts`, the same sessions are enough.
    """
    who = ["provider", "session_id"]
    rows = availability.select(*LINE, *who)
    if parts:  # equal ratios are equal doubles
        who = [*who, "_part"]
        rows = availability.withColumn("_part", F.col("avail") / F.sum("avail").over(Window.partitionBy(*BY_LINE))).select(*LINE, *who)
    member = lambda seed: F.bit_xor(F.xxhash64(*who, F.lit(seed)))
    lines = written(rows.groupBy(*LINE).agg(member(1).alias("_a"), member(2).alias("_b"), F.count("*").alias("_n")).select(*LINE, F.struct("_a", "_b", "_n").alias("_class")))
    one = lines.groupBy("_class").agg(F.min(F.struct(*LINE)).alias("_line")).select("_class", "_line.*")
    return lines, rows.join(one, BY_LINE).select("_class", *who)


def classes_of(chosen: DataFrame, lines: DataFrame) -> DataFrame:
    """`chosen` with the class of the line that each matches."""
    return chosen.join(lines.withColumnRenamed("rel_path", "_path"), ["line_hash", "_path", "repo_root", "side"])


#: Sessions of a commit's smaller classes up to this number are kept in one row.
FEW = 256
#: Pairs of commits and sessions that one bucket of a class makes.
BUCKET_PAIRS = 1 << 21
CHANGED, GOT = "total_added + total_removed", "matched_added_lines + matched_removed_lines"


def commit_facts(matched: Matched) -> DataFrame:
    """(COMMIT, totals, ai_share, heavy_ai) of each commit."""
    commit = ["repo_root", "commit_sha"]
    side_total = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c)).otherwise(0))
    lines = matched.lines.groupBy(*commit).agg(side_total("+", "count").alias("total_added"), side_total("-", "count").alias("total_removed"))
    got = matched.matched_by_file.groupBy(*commit).agg(side_total("+", "matched").alias("matched_added_lines"), side_total("-", "matched").alias("matched_removed_lines"))
    totals = lines.join(got, commit, "left").fillna(0, ["matched_added_lines", "matched_removed_lines"])
    changed, matched_lines = F.expr(CHANGED), F.expr(GOT)
    return totals.withColumn("matched_total_lines", matched_lines).withColumn("ai_share", F.when(changed > 0, matched_lines / changed).otherwise(0.0)).withColumn("heavy_ai", (F.col("ai_share") >= HEAVY_SHARE).cast("int"))


def session_shares(matched: Matched, commits: DataFrame, of_commits: DataFrame | None = None, of_sessions: DataFrame | None = None) -> DataFrame:
    """(COMMIT, provider, session_id, lines and shares) of the commits of `commit_facts`; a human row if nothing matched.

    There can be a row for every commit and every session, so rows are made last and aren't moved: a commit's largest class
    of lines meets its sessions in buckets, and the sums of the sessions of its other classes, if they are few, are told
    apart by a list in the commit's row. Commits with many sessions in several classes are summed by a shuffle. More columns of the
    commits that shall have rows (`of_commits`, with COMMIT) and of sessions (`of_sessions`, with provider and session_id) are
    joined before that.
    """
    commit, session, changed = ["repo_root", "commit_sha"], ["provider", "session_id"], F.expr(CHANGED)
    by_line, members = line_classes(matched.availability)
    members = written(members)
    kept = commits if of_commits is None else commits.join(of_commits, commit)
    more = [c for c in kept.columns if c not in commits.columns]
    told = members if of_sessions is None else members.join(of_sessions, session, "left")
    about = [c for c in told.columns if c not in members.columns]
    classes = classes_of(matched.chosen, by_line).groupBy(*commit, "_class").agg(F.sum("matched").alias("matched"))
    sizes = members.groupBy("_class").agg(F.count("*").alias("_size"))
    of_commit = Window.partitionBy(*commit)
    ranked = classes.join(sizes, "_class").withColumns({"_rank": F.row_number().over(of_commit.orderBy(F.desc("_size"), "_class")), "_rest": F.sum("_size").over(of_commit) - F.max("_size").over(of_commit)})
    ranked = written(ranked)
    main, few = ranked.filter(f"_rank = 1 AND _rest <= {FEW}"), ranked.filter(f"_rank > 1 AND _rest <= {FEW}")
    lines = lambda rows: rows.groupBy(*commit, *session).agg(F.sum(F.col("matched") * F.col("_part")).alias("matched_lines"))
    # sessions of the smaller classes, with what the largest one gives them
    others = written(lines(few.join(members, "_class")))
    in_main = main.select(*commit, "_class", "matched").join(others, commit).join(members, ["_class", *session], "left")
    summed = in_main.select(*commit, *session, (F.col("matched_lines") + F.coalesce(F.col("matched") * F.col("_part"), F.lit(0.0))).alias("matched_lines"))
    summed = summed.unionByName(lines(ranked.filter(f"_rest > {FEW}").select(*commit, "_class", "matched").join(members, "_class")))
    # all other sessions of the largest class
    heads = main.join(others.groupBy(*commit).agg(F.collect_list(F.struct(*session)).alias("_others")), commit, "left").join(kept, commit)
    met = main.groupBy("_class", "_size").agg(F.count("*").alias("_commits")).select("_class", F.ceil(F.col("_size") * F.col("_commits") / BUCKET_PAIRS).cast("int").alias("_buckets"))
    dealt = heads.join(met, "_class").withColumn("_bucket", F.pmod(F.xxhash64(*commit), F.col("_buckets")).cast("int"))
    copies = told.join(met, "_class").withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1))).drop("_buckets")
    pairs = dealt.join(copies, ["_class", "_bucket"]).filter(F.col("_others").isNull() | ~F.array_contains("_others", F.struct(*session)))
    of_pairs = pairs.withColumn("matched_lines", F.col("matched") * F.col("_part"))
    of_sums = summed.join(kept, commit)
    if of_sessions is not None:
        of_sums = of_sums.join(of_sessions, session, "left")

    def shares(rows: DataFrame) -> DataFrame:
        return rows.select(
            *commit, *session, "matched_lines",
            F.when(changed > 0, F.col("matched_lines") / changed).otherwise(0.0).alias("share_of_commit"),
            F.when(F.col("matched_total_lines") > 0, F.col("matched_lines") / F.col("matched_total_lines")).otherwise(0.0).alias("share_of_ai"), *more, *about,
        )

    human = kept.filter("matched_total_lines = 0").select(
        *commit, F.lit("human").alias("provider"), F.lit("__human__").alias("session_id"), F.lit(0.0).alias("matched_lines"), F.lit(1.0).alias("share_of_commit"), F.lit(0.0).alias("share_of_ai"), *more
    )
    if of_sessions is not None:
        human = human.join(of_sessions, session, "left").select(*commit, *session, "matched_lines", "share_of_commit", "share_of_ai", *more, *about)
    return shares(of_pairs).unionByName(shares(of_sums)).unionByName(human)


def attributed(commit_rows: DataFrame, session_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per commit (totals, share, heavy_ai) and per commit and session (lines and shares; a human row if nothing matched)."""
    matched = Matched(commit_rows, session_rows)
    facts = commit_facts(matched)
    return facts, session_shares(matched, facts)


def matches_within(commit_rows: DataFrame, session_rows: DataFrame, commits: DataFrame, spans: DataFrame, hours: int = 4) -> DataFrame:
    """(provider, session_id, commit_time) of commits that match lines of a session, from its begin until `hours` after its end:
    of each class of its lines the first one, so that a session has a row if and only if there is any such commit.

    `spans` are (provider, session_id, _begin, _end). Commits and sessions of a class of lines are sorted by time together,
    and a running minimum from the end tells each session the next commit after its begin.
    """
    lines = Matched(commit_rows, session_rows)
    until = F.col("_end") + F.expr(f"INTERVAL {hours} HOURS")
    by_line, members = line_classes(lines.availability, parts=False)
    session = F.struct("provider", "session_id", "_until").alias("_own")
    held = members.join(spans, ["provider", "session_id"]).withColumn("_until", until).filter(F.col("_until") >= F.col("_begin")).select("_class", F.col("_begin").alias("_t"), session)
    of_class = classes_of(lines.chosen, by_line).select("repo_root", "commit_sha", "_class").distinct()
    timed = of_class.join(commits.select("repo_root", "commit_sha", "commit_time"), ["repo_root", "commit_sha"]).select("_class", F.col("commit_time").alias("_t")).filter("_t IS NOT NULL").distinct()
    # from the end; commits come before the sessions that begin at their time
    from_end = Window.partitionBy("_class").orderBy(F.desc("_t"), F.col("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = held.unionByName(timed, allowMissingColumns=True).withColumn("commit_time", F.min(F.when(F.col("_own").isNull(), F.col("_t"))).over(from_end)).filter("_own IS NOT NULL")
    return swept.filter(F.col("commit_time") <= F.col("_own._until")).select("_own.provider", "_own.session_id", "commit_time").distinct()


#: Lines up to this number (about 100 bytes each) are broadcast; more join by shuffle.
MOST_LINES = 100_000


def on_lines(lines: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Rows of `tables` whose line (line_hash, rel_path, repo_root) `lines` have: all that matters where other lines tell nothing."""
    keys = ["line_hash", "rel_path", "repo_root"]
    known = written(lines.select(*keys).distinct())
    few = known.limit(MOST_LINES + 1).count() <= MOST_LINES
    return [rows.join(F.broadcast(known) if few else known, keys, "left_semi") for rows in tables]


def ai_budget(commit_rows: DataFrame, session_rows: DataFrame) -> DataFrame:
    """(FILE, line_hash, budget): added lines of a commit that sessions can account for. Both are dealt by line once, for their sums and the join."""
    line = ["line_hash", "rel_path", "repo_root"]
    added = commit_rows.filter("side = '+'").repartition(*line).groupBy(*FILE, "line_hash").agg(F.sum("count").alias("n"))
    have = provider_availability(session_rows.repartition(*line))
    return added.join(have, line).select(*FILE, "line_hash", F.least("n", "avail").alias("budget")).filter("budget > 0")
