"""Review of evidence against gold: labels of lookups and calls, manual decisions, failure stages, reachability, consistency, strata that a sample must cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators.relations import SNAPSHOT, seeded
from trawl.storage import settings

#: Labels that a reviewer may give.
LABELS = ("correct_mapping", "overly_ambiguous", "incorrect_mapping")


def gold_of(gold: DataFrame) -> DataFrame:
    """(ticket_id, gold_file): distinct normalised files of mapped gold rows."""
    return gold.filter("ticket_id IS NOT NULL AND mapping_status = 'mapped'").select("ticket_id", T.norm_path(F.col("file_path")).alias("gold_file")).filter("gold_file <> ''").distinct()


def labelled_evidence(evidence: DataFrame, gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """(ticket_id, label, files, gold_files, extra_files, exact, leaf, best_rank): every ticket with evidence, held against its gold files.

    ``evidence``: ticket_id, symbol, file_path, match (exact or leaf), repeated rows count once. correct_mapping if all files are gold, overly_ambiguous if some are, incorrect_mapping
    if none is (also where the ticket has no gold). best_rank is the best rank of an evidence file in ``ranked`` (null if none is ranked).
    """
    rows = evidence.select("ticket_id", "symbol", T.norm_path(F.col("file_path")).alias("file"), "match").distinct()
    hit = rows.join(gold.select("ticket_id", F.col("gold_file").alias("file"), F.lit(1).alias("g")), ["ticket_id", "file"], "left").join(ranked.select("ticket_id", F.col("file_path").alias("file"), "rank"), ["ticket_id", "file"], "left")
    n = lambda c: F.count_distinct(F.when(c, F.col("file")))
    x = hit.groupBy("ticket_id").agg(F.count_distinct("file").alias("files"), n(F.col("g") == 1).alias("gold_files"), n(F.col("g").isNull()).alias("extra_files"), F.count_distinct(F.when(F.col("match") == "exact", F.struct("symbol", "file"))).alias("exact"), F.count_distinct(F.when(F.col("match") == "leaf", F.struct("symbol", "file"))).alias("leaf"), F.min("rank").alias("best_rank"))
    label = F.when(F.col("gold_files") == 0, LABELS[2]).when(F.col("extra_files") == 0, LABELS[0]).otherwise(LABELS[1])
    return x.select("ticket_id", label.alias("label"), "files", "gold_files", "extra_files", "exact", "leaf", "best_rank")


def lookup_evidence(names: DataFrame, keys: DataFrame, max_files: int = 4) -> tuple[DataFrame, DataFrame]:
    """(evidence, names that hit too many files): exact hits of program names, and leaf hits of dotted names without one."""
    hit = lambda n, key, how: n.join(keys.withColumnRenamed("lookup_key", key), [*SNAPSHOT, key]).select("ticket_id", *SNAPSHOT, "symbol", "file_path", F.lit(how).alias("match")).distinct()
    exact = hit(names.withColumn("key", F.col("symbol")), "key", "exact")
    rest = names.join(exact.select("ticket_id", *SNAPSHOT, "symbol").distinct(), ["ticket_id", *SNAPSHOT, "symbol"], "left_anti").filter(F.col("symbol").contains("."))
    both = exact.union(hit(rest.withColumn("key", F.substring_index("symbol", ".", -1)), "key", "leaf"))
    spread = both.groupBy("ticket_id", *SNAPSHOT, "symbol").agg(F.count_distinct("file_path").alias("n"))
    few = spread.filter(F.col("n") <= max_files).drop("n")
    return both.join(few, ["ticket_id", *SNAPSHOT, "symbol"], "left_semi"), spread.filter(F.col("n") > max_files)


def expansion_diagnostics(names: DataFrame, evidence: DataFrame, rejected: DataFrame, most: int = 12) -> DataFrame:
    """(ticket_id, names, matched, rejected, unmatched, files, evidence): what became of a ticket's names; evidence holds the first ``most`` distinct ``symbol=file`` in order."""
    per = lambda df, c: df.groupBy("ticket_id").agg(F.count_distinct("symbol").alias(c))
    pairs = evidence.select("ticket_id", F.concat_ws("=", "symbol", "file_path").alias("p"), "file_path").distinct()
    order = pairs.select("ticket_id", "p").distinct().withColumn("k", F.row_number().over(Window.partitionBy("ticket_id").orderBy("p"))).filter(F.col("k") <= most)
    shown = order.groupBy("ticket_id").agg(F.array_join(F.array_sort(F.collect_list("p")), " ").alias("evidence"))
    files = pairs.groupBy("ticket_id").agg(F.count_distinct("file_path").alias("files"))
    x = per(names, "names").join(per(evidence, "matched"), "ticket_id", "left").join(per(rejected, "rejected"), "ticket_id", "left").join(files, "ticket_id", "left").join(shown, "ticket_id", "left").na.fill(0, ["matched", "rejected", "files"])
    return x.select("ticket_id", "names", "matched", "rejected", (F.col("names") - F.col("matched") - F.col("rejected")).alias("unmatched"), "files", F.coalesce("evidence", F.lit("")).alias("evidence"))


def exact_names(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, chunk_id, name): the first program name of a report (by its place there) that equals a chunk's qualified name or leaf; it forces the identifier signal to 1."""
    qualified = F.lower(F.concat_ws(".", F.nullif(F.col("class_name"), F.lit("")), F.nullif(F.col("function_name"), F.lit(""))))
    keys = chunks.select(*SNAPSHOT, "chunk_id", qualified.alias("q")).filter("q <> ''").select(*SNAPSHOT, "chunk_id", F.explode(F.array_distinct(F.array("q", F.substring_index("q", ".", -1)))).alias("symbol")).distinct()
    hits = names.join(keys, [*SNAPSHOT, "symbol"])
    return hits.groupBy("ticket_id", *SNAPSHOT, "chunk_id").agg(F.min(F.struct("at", "symbol")).alias("x")).select("ticket_id", "chunk_id", F.col("x.symbol").alias("name"))


def call_evidence(evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """(evidence_id, ticket_id, reference_file, reference_rank, target_file, call_name, target_is_gold, reference_is_gold, hint): each call that brought a file in, once.

    ``evidence``: ticket_id, reference_file, reference_rank, target_file, call_name; rows that agree in all of them are one. The id is a digest of them.
    """
    sign = ["ticket_id", "reference_file", "reference_rank", "target_file", "call_name"]
    rows = evidence.select(*sign).dropDuplicates(sign)
    is_gold = lambda c, out: gold.select("ticket_id", F.col("gold_file").alias(c), F.lit(True).alias(out))
    x = rows.join(is_gold("target_file", "t"), ["ticket_id", "target_file"], "left").join(is_gold("reference_file", "r"), ["ticket_id", "reference_file"], "left")
    digest = F.substring(F.sha1(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in sign])), 1, 12)
    target = F.coalesce("t", F.lit(False))
    return x.select(F.concat(F.lit("call-"), digest).alias("evidence_id"), *sign, target.alias("target_is_gold"), F.coalesce("r", F.lit(False)).alias("reference_is_gold"), F.when(target, LABELS[0]).otherwise("unreviewed").alias("hint"))


def decided(cases: DataFrame, decisions: DataFrame, require_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases with their final label and reason, issues): manual decisions (ticket_id, label, reason) replace a case's own label.

    A decision with an unknown label or without a reason, a ticket with several decisions, and with ``require_all`` a case without one, are issues; such cases keep their own label.
    """
    reason = F.trim(F.coalesce("reason", F.lit("")))
    d = decisions.filter("ticket_id IS NOT NULL").select("ticket_id", F.col("label").alias("said"), reason.alias("reason")).distinct()
    many = d.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n"))
    x = cases.select("ticket_id", "label").join(d.groupBy("ticket_id").agg(F.max(F.struct("said", "reason")).alias("d")), "ticket_id", "left").join(many, "ticket_id", "left")
    issue = (
        F.when(F.col("d").isNull(), F.when(F.lit(require_all), "missing"))
        .when(F.col("n") > 1, "several")
        .when(~F.coalesce(F.col("d.said"), F.lit("")).isin(*LABELS), "label")
        .when(F.col("d.reason") == "", "reason")
    )
    x = x.withColumn("issue", issue)
    good = F.col("d").isNotNull() & F.col("issue").isNull()
    final = x.select("ticket_id", F.when(good, F.col("d.said")).otherwise(F.col("label")).alias("label"), good.alias("reviewed"), F.when(good, F.col("d.reason")).otherwise("").alias("reason"))
    return final, x.filter("issue IS NOT NULL").select("ticket_id", "issue")


def failure_stages(gold: DataFrame, final: DataFrame, first: DataFrame, snapshots: DataFrame, files: DataFrame, k: int = 20, pool: int = 50) -> DataFrame:
    """(ticket_id, missed, stage): why a ticket's missed gold files were missed; tickets that missed none are left out.

    ``gold``: ticket_id, repo, base_commit, gold_file; ``final`` and ``first``: ticket_id, file_path, rank; ``snapshots``: repo, base_commit that are indexed; ``files``: repo, base_commit, file_path.
    A missed file is unavailable (its snapshot is not indexed), coverage (the snapshot lacks it), retrieval (it is not among the first ``pool``) or rerank; of a ticket's
    files unavailable goes before coverage, and retrieval together with rerank is mixed.
    """
    top = lambda df, n, out: df.filter(F.col("rank") <= n).select("ticket_id", F.col("file_path").alias("gold_file"), F.lit(1).alias(out)).distinct()
    x = gold.join(top(final, k, "f"), ["ticket_id", "gold_file"], "left").filter("f IS NULL")
    x = x.join(snapshots.select(*SNAPSHOT, F.lit(1).alias("s")).distinct(), SNAPSHOT, "left").join(files.select(*SNAPSHOT, F.col("file_path").alias("gold_file"), F.lit(1).alias("i")).distinct(), [*SNAPSHOT, "gold_file"], "left").join(top(first, pool, "p"), ["ticket_id", "gold_file"], "left")
    has = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    gone, lacks = F.col("s").isNull(), F.col("s").isNotNull() & F.col("i").isNull()
    miss, fell = F.col("i").isNotNull() & F.col("p").isNull(), F.col("i").isNotNull() & F.col("p").isNotNull()
    stage = F.when(has(gone), "unavailable").when(has(lacks), "coverage").when(has(miss) & has(fell), "mixed").when(has(miss), "retrieval").otherwise("rerank")
    return x.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("missed"), stage.alias("stage"))


def unresolved_calls(calls: DataFrame, resolved: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ticket_id, target_leaf, caller_file, call_name): calls in a ticket's files that resolve to no one place and whose last name is the wanted one.

    ``calls``: repo, base_commit, caller_file, call_name; ``resolved`` the same columns; ``wanted``: ticket_id, repo, base_commit, caller_file, target_leaf.
    """
    keys = [*SNAPSHOT, "caller_file", "call_name"]
    open_calls = calls.select(*keys).distinct().join(resolved.select(*keys).distinct(), keys, "left_anti").withColumn("target_leaf", F.lower(F.substring_index("call_name", ".", -1)))
    return wanted.distinct().join(open_calls, [*SNAPSHOT, "caller_file", "target_leaf"]).select("ticket_id", "target_leaf", "caller_file", "call_name").distinct()


def reachability(targets: DataFrame, edges: DataFrame, ranked: DataFrame, prefix: int = 5, pool: int = 20) -> DataFrame:
    """(ticket_id, target_file, kind, reach): whether a target file is one call away from a ticket's first files (prefix), from its other ranked files (outside), or from none.

    ``targets``: ticket_id, repo, base_commit, target_file, kind. Calls count in both directions.
    """
    pairs = edges.select(*SNAPSHOT, F.col("caller_file").alias("target_file"), F.col("target_file").alias("peer")).union(edges.select(*SNAPSHOT, "target_file", "caller_file")).distinct()
    near = ranked.filter(F.col("rank") <= pool).select("ticket_id", F.col("file_path").alias("peer"), "rank")
    met = targets.distinct().join(pairs, [*SNAPSHOT, "target_file"], "left").join(near, ["ticket_id", "peer"], "left")
    best = met.groupBy("ticket_id", "target_file", "kind").agg(F.min("rank").alias("rank"))
    return best.select("ticket_id", "target_file", "kind", F.when(F.col("rank") <= prefix, "prefix").when(F.col("rank").isNotNull(), "outside").otherwise("none").alias("reach"))


def gold_rows(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(ticket_id, repo, base_commit, file_path, mapping_status, kind, reason): a module row for each file whose report allows one, an excluded row with the report's reason for the others.

    ``reports``: repo, base_commit, file_path, status, one row per file; a file without a report is missing.
    """
    reason = F.create_map(*[F.lit(x) for pair in EXCLUSIONS.items() for x in pair])
    x = files.join(reports, [*SNAPSHOT, "file_path"], "left").withColumn("reason", F.coalesce(reason[F.coalesce("status", F.lit("missing_file"))], F.lit("")))
    ok = F.col("reason") == ""
    return x.select("ticket_id", *SNAPSHOT, "file_path", F.when(ok, "mapped").otherwise("excluded").alias("mapping_status"), F.when(ok, "module").alias("kind"), F.when(~ok, F.col("reason")).alias("reason"))


#: The reason for which a file with such a report is left out.
EXCLUSIONS = {"syntax_error": "parser_failure", "parser_error": "parser_failure", "unsupported_language": "unsupported_language", "missing_file": "missing_base_file", "invalid_path": "invalid_path", "symlink_escape": "symlink_escape"}


def features(hunks: DataFrame) -> DataFrame:
    """(doc_id, feature): what the diffs of a text have: multi_file, pure_addition, deletion_evidence, deleted_file."""
    added, deleted = F.col("added") > 0, F.col("deleted") > 0
    per = hunks.groupBy("doc_id").agg(F.count_distinct(F.coalesce(F.nullif("new_file", F.lit("")), F.col("old_file"))).alias("files"), F.max(((F.col("change") != "added") & added & ~deleted).cast("int")).alias("plus"), F.max(deleted.cast("int")).alias("minus"), F.max((F.col("change") == "deleted").cast("int")).alias("gone"))
    names = F.array_compact(F.array(F.when(F.col("files") > 1, "multi_file"), F.when(F.col("plus") == 1, "pure_addition"), F.when(F.col("minus") == 1, "deletion_evidence"), F.when(F.col("gone") == 1, "deleted_file")))
    return per.select("doc_id", F.explode(names).alias("feature"))


def covering_sample(rows: DataFrame, minimums: dict[str, int], size: int, repositories: int, seed: int) -> DataFrame:
    """(item, repo, place, reason): a sample that has each stratum's minimum and so many repositories, then is filled in hash order; short strata are an error.

    ``rows``: item, repo, strata (array). Always the row that helps the most open strata is taken next, then one of a new repository, then the first in hash order. Only
    the first ``size`` rows in hash order of each set of strata and each repository can be taken, so the choice runs over a table of bounded size; the sample size is the feature.
    """
    order = seeded(seed, F.col("item"))
    distinct = rows.groupBy("item", "repo").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("strata")))).alias("strata")).withColumn("h", order)
    key = F.array_join("strata", "|")
    near = distinct.withColumn("key", key).withColumn("k", F.row_number().over(Window.partitionBy("key", "repo").orderBy("h", "item"))).filter(F.col("k") <= 1).union(
        distinct.withColumn("key", key).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("h", "item"))).filter(F.col("k") <= size)
    ).select("item", "repo", "strata", "h").distinct()
    left = [(r["h"], r["item"], r["repo"], set(r["strata"])) for r in settings(near.orderBy("h", "item"), 200_000)]
    have = dict.fromkeys(minimums, 0)
    picked: list[tuple[str, str, str, str]] = []
    repos: set[str] = set()

    def take(x: tuple[str, str, str, set[str]], why: str) -> None:
        left.remove(x)
        picked.append((x[1], x[2], x[0], why))
        repos.add(x[2])
        for s in x[3]:
            if s in have:
                have[s] += 1

    while any(have[s] < n for s, n in minimums.items()):
        gain = lambda x: sum(have[s] < n and s in x[3] for s, n in minimums.items())
        best = min(left, key=lambda x: (-gain(x), x[2] in repos, x[0]), default=None)
        if best is None or not gain(best) or len(picked) >= size:
            raise ValueError("the strata's minimums cannot be met")
        take(best, "stratum")
    for x in list(left):
        if len(repos) < repositories and x[2] not in repos and len(picked) < size:
            take(x, "repository")
    if len(repos) < repositories:
        raise ValueError("there are not enough repositories")
    for x in left[: max(0, size - len(picked))].copy():
        take(x, "fill")
    out = [(i, r, n, why) for n, (i, r, _, why) in enumerate(sorted(picked, key=lambda x: x[2]), 1)]
    return rows.sparkSession.createDataFrame(out, "item string, repo string, place int, reason string")


def note(stage: Column, missed: Column, issues: Column) -> Column:
    """One line for a reviewer."""
    return F.format_string("%s: %d missed%s", stage, missed, F.when(issues != "", F.concat(F.lit("; "), issues)).otherwise(""))


def rank_issues(outcome: Column, first_rank: Column, found: Column, gold: Column) -> Column:
    """What contradicts in a ticket's outcome, its first rank and its counts, joined by commas."""
    checks = {"full_without_all": (outcome == "full") & (found < gold), "miss_with_found": (outcome == "miss") & (found > 0), "partial_bounds": (outcome == "partial") & ((found == 0) | (found >= gold)), "rank_without_found": (first_rank <= 20) & (found == 0), "found_without_rank": first_rank.isNull() & (found > 0)}
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()])), ",")
