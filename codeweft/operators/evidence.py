"""Evidence, gaps and runs: latest evidence per criterion, what is unproven, preference dedupe, timelines, retention.

The frames are given by the caller with the columns each function names; nothing here knows where
they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: severities from the gravest on.
SEVERITIES = ("critical", "high", "medium", "low")


def severity_rank(c: Column | str) -> Column:
    """0 for the gravest severity, 9 for an unknown one."""
    c = F.col(c) if isinstance(c, str) else c
    known = F.create_map(*[F.lit(x) for kv in zip(SEVERITIES, range(len(SEVERITIES))) for x in kv])
    return F.coalesce(known[F.lower(c)], F.lit(9))


def evidence_matrix(criteria: DataFrame, evidence: DataFrame) -> DataFrame:
    """The last evidence of every criterion: criterion_id, status; ``no_evidence`` where there is none.

    ``evidence`` has criterion_id, ordinal, status. Partial aggregates pick the last one, whatever the skew.
    """
    last = evidence.where("criterion_id is not null").groupBy("criterion_id").agg(F.max_by("status", F.struct("ordinal", "status")).alias("status"))
    c = criteria.select("criterion_id").where("criterion_id is not null").distinct()
    return c.hint("merge").join(last.hint("merge"), "criterion_id", "left").select("criterion_id", F.coalesce("status", F.lit("no_evidence")).alias("status"))


def unproven(criteria: DataFrame, *proofs: DataFrame) -> DataFrame:
    """Criteria that none of the proofs (criterion_id) names: criterion_id."""
    out = criteria.select("criterion_id").where("criterion_id is not null").distinct()
    for p in proofs:
        out = out.hint("merge").join(p.select("criterion_id").hint("merge"), "criterion_id", "left_anti")
    return out


def coverage_summary(criteria: DataFrame, evidence: DataFrame, passed: str = "passed") -> DataFrame:
    """One row: criteria, with_evidence, passed, failed, without_evidence, share (of those passed)."""
    m = evidence_matrix(criteria, evidence)
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == passed)
    none = F.count_if(F.col("status") == "no_evidence")
    return m.agg(n.alias("criteria"), (n - none).alias("with_evidence"), ok.alias("passed"), (n - none - ok).alias("failed"), none.alias("without_evidence"), F.round(ok / F.greatest(n, F.lit(1)), 6).alias("share"))


def preferred(gaps: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One gap per identity: a blocking one first, then the gravest, then the first by ``order``; all columns stay.

    A partial aggregate by the least struct, so that repeated gaps meet map-side.
    """
    rest = [c for c in gaps.columns if c not in identity]
    key = F.struct((~F.coalesce("blocking", F.lit(False))).alias("a"), severity_rank("severity").alias("b"), *order)
    best = gaps.groupBy(*identity).agg(F.min_by(F.struct(*rest), key).alias("_r"))
    return best.select(*identity, *[F.col("_r")[c].alias(c) for c in rest])


def gap_counts(gaps: DataFrame, by: list[str]) -> DataFrame:
    """Blocking and advisory gaps per group: by, blocking, advisory, gravest (name of the gravest severity)."""
    b = F.coalesce("blocking", F.lit(False))
    gravest = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.min(severity_rank("severity")).cast("int") + 1)
    return gaps.groupBy(*by).agg(F.count_if(b).alias("blocking"), F.count_if(~b).alias("advisory"), F.when(F.min(severity_rank("severity")) < len(SEVERITIES), gravest).alias("gravest"))


def repair_order(gaps: DataFrame, cap: int) -> DataFrame:
    """The blocking gaps to mend first: by severity, then type, then ordinal; text cut to 200 characters: ordinal, severity, kind, text."""
    text = F.when(F.length("text") > 200, F.concat(F.left("text", F.lit(197)), F.lit("..."))).otherwise(F.col("text"))
    first = gaps.where("blocking").orderBy(severity_rank("severity"), "kind", "ordinal").limit(cap)
    return first.select("ordinal", "severity", "kind", text.alias("text"))


def timeline(events: DataFrame, run: Column, last: int) -> DataFrame:
    """The last events of a run in order of time; ``run`` is the condition that an event belongs to it."""
    return events.where(run).orderBy(F.desc("ts"), F.desc("event_id")).limit(last)


def observed_sessions(observations: DataFrame, sessions: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """Observations with what their session tells, of one fingerprint or of all: session_id, ordinal, fingerprint, and the rest."""
    s = sessions if fingerprint is None else sessions.where(F.col("fingerprint") == fingerprint)
    return observations.hint("merge").join(s.hint("merge"), "session_id")


def append_ordinals(existing: DataFrame, new: DataFrame, by: str, order: list[str]) -> DataFrame:
    """New rows with ordinals that go on from the greatest one of their group: all columns of ``new`` and ordinal.

    Groups are ranked by a window; a group's new rows are one batch of appends.
    """
    last = existing.groupBy(by).agg(F.max("ordinal").alias("_last"))
    w = Window.partitionBy(by).orderBy(*order)
    numbered = new.withColumn("_k", F.row_number().over(w))
    return numbered.hint("merge").join(last.hint("merge"), by, "left").select(*new.columns, (F.coalesce("_last", F.lit(0)) + F.col("_k")).alias("ordinal"))


def orphaned(runs: DataFrame, now: Column, after_seconds: int) -> DataFrame:
    """Runs with a flag: run_id, status, orphaned; a run is orphaned that still runs but was last touched too long ago."""
    age = F.unix_micros(now) - F.unix_micros("touched")
    return runs.select("run_id", "status", ((F.col("status") == "running") & (age > after_seconds * 1_000_000)).alias("orphaned"))


def retained(messages: DataFrame, keep: int) -> DataFrame:
    """A mailbox after draining: all unread messages and the last ``keep`` read ones per agent: agent, message_id, unread."""
    w = Window.partitionBy("agent").orderBy(F.desc("sent"), F.desc("message_id"))
    unread = messages.where("unread").select("agent", "message_id", "unread")
    read = messages.where("not unread").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).select("agent", "message_id", "unread")
    return unread.unionByName(read)


def stale_hashes(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Gates that must run again: gate, input_hash; those whose inputs' hash the cache holds as passed are left out."""
    green = cache.where("passed").select("gate", "input_hash").distinct()
    return inputs.hint("merge").join(green.hint("merge"), ["gate", "input_hash"], "left_anti")


def stale_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages to write anew: page, state; ``missing`` without a page, ``outdated`` with another fingerprint than the source's."""
    j = sources.alias("s").hint("merge").join(pages.alias("p").hint("merge"), "page", "left")
    state = F.when(F.col("p.fingerprint").isNull(), "missing").when(~F.col("p.fingerprint").eqNullSafe(F.col("s.fingerprint")), "outdated")
    return j.select("page", state.alias("state")).where("state is not null")


def broken_links(documents: DataFrame) -> DataFrame:
    """Links between documents of a bundle that lead nowhere: id, link. ``documents`` has id and text; links are [..](id)."""
    links = documents.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s#]+)"), F.lit(1))).alias("link")).distinct()
    outside = F.col("link").rlike(r"^[a-z]+:")
    return links.where(~outside).hint("merge").join(documents.select(F.col("id").alias("link")).distinct().hint("merge"), "link", "left_anti").select("id", "link")


def mean_score(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean of scores clamped to 0..1, a missing one counting 0: by, n, mean."""
    s = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))), F.lit(0.0))
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean"))


def merge_coverage(parts: DataFrame) -> DataFrame:
    """Line coverage of several tools merged: path, executable, executed, tools. ``parts`` has path, line, executed, tool.

    A line counts once however many tools measured it, and as executed if one saw it.
    """
    lines = parts.groupBy("path", "line").agg(F.max("executed").alias("executed"), F.collect_set("tool").alias("tools"))
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("executable"), F.count_if("executed").alias("executed"), F.concat_ws("+", F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools"))))).alias("tools")
    )


def grep(lines: DataFrame, text: str, last: int) -> DataFrame:
    """The last lines that hold a text in any letter case: id, line, text."""
    return lines.where(F.lower("text").contains(text.lower())).orderBy(F.desc("id"), F.desc("line")).limit(last)
