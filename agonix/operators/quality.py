"""Quality rules as rows of one issues table (code, severity, entity_type, entity_id, field), quarantine and eligibility.

Rules on a contest's own legs and rosters are array expressions exploded once; only duplicate detection joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that stand for a leg that wasn't played, and severities in order.
PLACEHOLDERS = ["n/a", "na", "tbd", "unplayed", "decider", ""]
SEVERITY = {"fatal": 0, "error": 1, "warning": 2, "info": 3}


def _issues(df: DataFrame, found: list[tuple[object, str, str, str]], entity: str = "match") -> DataFrame:
    """One row per condition that holds: (condition, code, severity, field)."""
    each = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(field).alias("field"))) for c, code, sev, field in found]
    x = df.select(F.col("contest_id"), F.explode(F.array_compact(F.array(*each))).alias("x"))
    return x.select("x.code", "x.severity", F.lit(entity).alias("entity_type"), F.col("contest_id").cast("string").alias("entity_id"), "x.field")


def roster_issues(c: DataFrame) -> DataFrame:
    """One side without a roster, repeated or too few players, sizes outside 3 to 6, players on both sides."""
    a, b = F.coalesce("roster_a", F.array().cast("array<bigint>")), F.coalesce("roster_b", F.array().cast("array<bigint>"))
    found = [((F.size(a) == 0) != (F.size(b) == 0), "roster-one-side", "warning", "rosters"), (F.size(F.array_intersect(a, b)) > 0, "player-both-sides", "error", "rosters")]
    for s, r in (("a", a), ("b", b)):
        found += [
            (F.size(F.array_distinct(r)) < F.size(r), "roster-duplicate-player", "error", f"roster_{s}"),
            ((F.size(r) > 0) & (F.size(r) < 5), "roster-incomplete", "warning", f"roster_{s}"),
            ((F.size(r) > 0) & ~F.size(r).between(3, 6), "roster-size", "info", f"roster_{s}"),
        ]
    return _issues(c, found, "roster")


def leg_issues(c: DataFrame) -> DataFrame:
    """Placeholder names and names that aren't recognised, one issue per leg."""
    x = c.select("contest_id", F.explode("legs").alias("leg"))
    hold = F.lower(F.trim(F.coalesce("leg.name", F.lit("")))).isin(PLACEHOLDERS)
    named = x.withColumn("field", F.concat(F.lit("leg_"), F.col("leg.leg")))
    out = named.select("contest_id", "field", F.when(hold, F.struct(F.lit("leg-placeholder").alias("code"), F.lit("info").alias("severity"))).when(~F.col("leg.recognized"), F.struct(F.lit("leg-unrecognised").alias("code"), F.lit("warning").alias("severity"))).alias("x")).where("x is not null")
    return out.select("x.code", "x.severity", F.lit("match").alias("entity_type"), F.col("contest_id").cast("string").alias("entity_id"), "field")


def score_issues(c: DataFrame) -> DataFrame:
    """Scores that can't be: foreign winner, negative, tie with a winner, winner behind on legs, splits above the total."""
    bad = lambda f: F.exists("legs", f)
    wins = lambda p, q: F.size(F.filter("legs", lambda x: x[p] > x[q]))
    wa, wb = wins("score_a", "score_b"), wins("score_b", "score_a")
    won = F.col("winner")
    return _issues(c, [
        (won.isNotNull() & (won != F.col("side_a")) & (won != F.col("side_b")), "foreign-winner", "fatal", "winner"),
        (bad(lambda x: (x["score_a"] < 0) | (x["score_b"] < 0)), "negative-score", "error", "legs"),
        (bad(lambda x: x["score_a"] == x["score_b"]), "tied-leg", "warning", "legs"),
        (bad(lambda x: x["attack_a"] + x["defense_a"] > x["score_a"]), "split-above-total", "error", "legs"),
        (won.isNull(), "no-winner", "error", "winner"),
        (((won == F.col("side_a")) & (wa < wb)) | ((won == F.col("side_b")) & (wb < wa)), "winner-behind-on-legs", "warning", "winner"),
    ])


def timestamp_issues(c: DataFrame, start_ms: int, end_ms: int, span: DataFrame | None = None) -> DataFrame:
    """Missing, out of scope, or outside the event's own range; span: event_id, first_ms, last_ms."""
    found = [(F.col("ts_ms").isNull(), "timestamp-missing", "error", "ts"), ((F.col("ts_ms") < start_ms) | (F.col("ts_ms") > end_ms), "out-of-scope", "warning", "ts")]
    if span is not None:
        c = c.join(span, "event_id", "left")
        found.append(((F.col("ts_ms") < F.col("first_ms")) | (F.col("ts_ms") > F.col("last_ms")), "outside-event", "warning", "ts"))
    return _issues(c, found)


def find_duplicates(c: DataFrame, hours: int = 24) -> DataFrame:
    """Pairs of contests of one unordered pair of sides within ``hours`` with the same format and non-empty leg sequence;
    confidence is high within one event. The sequence and format are join keys, and time is cut into windows of ``hours``
    with each row in its own and the next, so a pair that met often is not joined with itself in full."""
    seq = F.array_join(F.transform("legs", lambda x: x["name"]), "|")
    k = c.where("ts_ms is not null and size(legs) > 0").select(
        "contest_id", "ts_ms", "event_id", "series_format", F.least("side_a", "side_b").alias("lo"), F.greatest("side_a", "side_b").alias("hi"), seq.alias("seq"), F.floor(F.col("ts_ms") / (hours * 3_600_000)).alias("slot"))
    x = k.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))
    y = k.select(*[F.col(n).alias(f"o_{n}") for n in k.columns])
    same = (F.col("lo") == F.col("o_lo")) & (F.col("hi") == F.col("o_hi")) & (F.col("seq") == F.col("o_seq")) & (F.col("series_format") == F.col("o_series_format")) & (F.col("slot") == F.col("o_slot"))
    met = x.join(y, same & (F.abs(F.col("ts_ms") - F.col("o_ts_ms")) <= hours * 3_600_000) & (F.col("contest_id") != F.col("o_contest_id")))
    a, b = F.least("contest_id", "o_contest_id"), F.greatest("contest_id", "o_contest_id")
    return met.select(a.alias("id_a"), b.alias("id_b"), F.when(F.col("event_id") == F.col("o_event_id"), "high").otherwise("low").alias("confidence")).distinct()


def audit(c: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """All rules and duplicates; by_severity() puts them in the order of a report."""
    dup = find_duplicates(c).select(F.lit("duplicate-candidate").alias("code"), F.when(F.col("confidence") == "high", "warning").otherwise("info").alias("severity"), F.lit("match").alias("entity_type"), F.col("id_a").cast("string").alias("entity_id"), F.lit("contest_id").alias("field"))
    every = roster_issues(c).unionByName(leg_issues(c)).unionByName(score_issues(c)).unionByName(timestamp_issues(c, start_ms, end_ms)).unionByName(dup)
    return every


def by_severity(issues: DataFrame) -> DataFrame:
    """The report order."""
    order = F.lit(9)
    for name, k in SEVERITY.items():
        order = F.when(F.col("severity") == name, k).otherwise(order)
    return issues.orderBy(order, "code", "entity_id", "field")


def issue_summary(issues: DataFrame) -> DataFrame:
    """Count by severity, every severity present."""
    every = issues.sparkSession.createDataFrame([(s,) for s in SEVERITY], "severity string")
    return F.broadcast(every).join(issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("codes")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("codes", F.lit(0)).alias("codes"))


def quarantine(c: DataFrame, issues: DataFrame, fatal_codes: list[str], categories: DataFrame | None = None) -> DataFrame:
    """Contests with the reasons that keep them out; only issues of matches count, combined per contest first."""
    hit = issues.where("entity_type = 'match'").groupBy(F.col("entity_id").cast("long").alias("_id")).agg(F.bool_or((F.col("severity") == "fatal") | F.col("code").isin(fatal_codes)).alias("_fatal"))
    c = c.join(hit, F.col("contest_id") == F.col("_id"), "left")
    c = c.join(categories.select("contest_id", "category"), "contest_id", "left") if categories is not None else c.withColumn("category", F.lit(None).cast("string"))
    won = F.col("winner")
    reasons = F.array_compact(F.array(
        F.when(F.col("side_a").isNull() | F.col("side_b").isNull(), "missing-team"),
        F.when(won.isNotNull() & (won != F.col("side_a")) & (won != F.col("side_b")), "foreign-winner"),
        F.when(F.size(F.filter("legs", lambda x: x["score_a"].isNotNull() & x["score_b"].isNotNull())) <= 0, "no-scored-legs"),
        F.when(F.coalesce(F.col("category") != "current-approved", F.lit(False)), "reconciliation"),
        F.when(F.coalesce("_fatal", F.lit(False)), "fatal-issue"),
    ))
    return c.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("contest_id", "reasons")


def harden(c: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Eligibility after quarantine: contest_id, eligible, reasons."""
    q = quarantined.select("contest_id", F.lit(True).alias("_q"))
    x = c.join(q, "contest_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("winner").isNull(), "no-winner"), F.when(F.col("ts_ms").isNull(), "no-timestamp"), F.when(F.size("legs") <= 0, "no-legs"), F.when(F.col("_q"), "quarantined")))
    return x.select("contest_id", reasons.alias("reasons")).select("contest_id", (F.size("reasons") == 0).alias("eligible"), "reasons")


def validate_features(f: DataFrame, rates: list[str], unsigned: list[str], label: str = "a_won") -> DataFrame:
    """Findings per row and column: rates outside 0..1 or not finite, negative counts, a label that isn't binary, and ids
    that are blank. Columns are unpivoted inside the row, so nothing is shuffled."""
    bad = [F.when(F.col(n).isNull() | F.isnan(n) | ~F.col(n).between(0, 1), F.struct(F.lit("rate-range").alias("code"), F.lit(n).alias("field"))) for n in rates]
    bad += [F.when(F.col(n) < 0, F.struct(F.lit("negative").alias("code"), F.lit(n).alias("field"))) for n in unsigned]
    bad += [F.when(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)), F.struct(F.lit("label").alias("code"), F.lit(label).alias("field"))), F.when(F.col("contest_id").isNull(), F.struct(F.lit("blank-id").alias("code"), F.lit("contest_id").alias("field")))]
    return f.select("contest_id", F.explode(F.array_compact(F.array(*bad))).alias("x")).select("contest_id", "x.code", "x.field")


def schema_drift(f: DataFrame, catalog: list[str]) -> DataFrame:
    """Columns that only the table or only the catalog has."""
    rows = [(n, "not-in-catalog") for n in f.columns if n not in set(catalog)] + [(n, "not-in-table") for n in catalog if n not in set(f.columns)]
    return f.sparkSession.createDataFrame(rows, "field string, drift string")


def validate_contract(df: DataFrame, required: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the contract, and rejected keys with the fields that are missing or not finite."""
    bad = F.array_compact(F.array(*[F.when(F.col(n).isNull() | F.isnan(F.col(n).cast("double")), F.lit(n)) for n in required]))
    x = df.withColumn("missing", bad)
    return x.where(F.size("missing") == 0).drop("missing"), x.where(F.size("missing") > 0).select(key, "missing")



def _zero_filled(counts: DataFrame, fixed: list[tuple[str, str]]) -> DataFrame:
    """section, name, value, with a 0 for each fixed pair that nothing was counted for."""
    zero = counts.sparkSession.createDataFrame([(s, n, 0.0) for s, n in fixed], "section string, name string, value double")
    return counts.select("section", "name", F.col("value").cast("double").alias("value")).unionByName(zero).groupBy("section", "name").agg(F.sum("value").alias("value"))


#: Error codes of a fetch that failed and of a page that couldn't be read.
NETWORK_ERRORS, PARSE_ERRORS = ["timeout", "rate_limited", "unexpected_status", "fetch_failed"], ["parse_failure", "critical_field_missing"]


def quality_report(c: DataFrame, events: DataFrame, discovered: DataFrame, failures: DataFrame, families: list[str], formats: list[str], duplicate_links: int = 0) -> DataFrame:
    """section, name, value: what a run has found and what its records lack, by year, family, format, leg and team.

    A contest is read once: it becomes one row per tag that holds for it, and all tags are counted in one grouping. Families,
    formats and totals are there with 0 too; teams without a mapping (id "team:...") are counted nowhere.
    c: normalize.normalize_contests(); events: event_id, inclusion; discovered: contest_id; failures: error_code."""
    flag = lambda code: F.array_contains("flags", code)
    done = F.col("status") == "completed"
    totals = {
        "normalized": F.lit(True), "eligible": F.col("eligible"), "ineligible": ~F.col("eligible"), "missing_team_mappings": flag("missing_team_mapping"), "ambiguous_timestamps": F.col("ts_confidence") == "none", "missing_series_format": flag("missing_series_format"),
        "missing_winner": done & F.col("winner").isNull(), "missing_legs": F.size("legs") == 0, "unknown_legs": F.exists("legs", lambda x: ~x["recognized"]), "incomplete_rosters": flag("incomplete_roster"), "forfeits": done & F.array_contains("reasons", "invalid_series_result"),
    }
    tag = lambda section, name: F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"))
    mapped = lambda s: F.when(~F.col(s).startswith("team:"), tag("team", F.col(s)))
    tags = F.array_compact(F.array(
        *[F.when(v, tag("total", F.lit(k))) for k, v in totals.items()], F.when(F.col("ts").isNotNull(), tag("year", F.year("ts"))), tag("family", F.col("family")), tag("format", F.col("series_format")), mapped("side_a"), mapped("side_b"),
    ))
    every = F.concat(tags, F.transform("legs", lambda x: tag("leg", x["name"])))
    counts = c.select(F.explode(every).alias("x")).groupBy("x.section", "x.name").agg(F.count(F.lit(1)).alias("value"))
    of = lambda df, what: df.groupBy(what.alias("name")).agg(F.count(F.lit(1)).alias("value")).where("name is not null").select(F.lit("total").alias("section"), "name", "value")
    kind = F.when(F.col("inclusion") == "included", "included_events").when(F.col("inclusion") == "unknown", "unknown_events").otherwise("excluded_events")
    error = F.when(F.col("error_code").isin(NETWORK_ERRORS), "network_failures").when(F.col("error_code").isin(PARSE_ERRORS), "parse_failures")
    counts = counts.unionByName(of(events, kind)).unionByName(of(events, F.lit("discovered_events"))).unionByName(of(discovered, F.lit("discovered_contests"))).unionByName(of(failures, error))
    fixed = [("total", n) for n in [*totals, "included_events", "excluded_events", "unknown_events", "discovered_events", "discovered_contests", "network_failures", "parse_failures"]]
    out = _zero_filled(counts, fixed + [("family", n) for n in families] + [("format", n) for n in formats])
    value = lambda n: F.max(F.when((F.col("section") == "total") & (F.col("name") == n), F.col("value")))
    share = out.agg(F.coalesce(F.floor(F.try_divide(value("eligible"), value("normalized")) * 1000 + 0.5) / 10, F.lit(0.0)).alias("value"))
    links = F.lit(float(duplicate_links))
    return out.unionByName(share.select(F.lit("total").alias("section"), F.lit("percent_eligible").alias("name"), "value")).unionByName(share.select(F.lit("total").alias("section"), F.lit("duplicate_links").alias("name"), links.alias("value")))


def prerun_report(events: DataFrame, discovered: DataFrame, failed: DataFrame, approved: list[str], scope_start: str, expected: tuple[str, ...] = ("masters", "champions"), duplicate_links: int = 0) -> DataFrame:
    """section, name, value: what a run would read, and anomalies a person should look at before it starts.

    included by approved family (0 too), excluded by reason, totals, and anomaly rows: a family without events, no links, more
    duplicate than unique links, more unknown events than half, failed discoveries, each event that begins before the scope.
    events: event_id, class, inclusion (event_inclusion()), start_date; discovered: contest_id, listed_status; failed: event_id."""
    known = F.col("inclusion") == "included"
    reason = F.when(F.col("inclusion").startswith("excluded:"), F.substring_index("inclusion", ":", -1)).otherwise(F.col("inclusion"))
    tag = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    tags = F.array_compact(F.array(
        tag("total", F.lit("candidate_events")), F.when(known, tag("included", F.col("class"))).when(F.col("inclusion") == "unknown", tag("total", F.lit("unknown_events"))).otherwise(tag("excluded", reason)),
        F.when(F.col("start_date").cast("timestamp") < F.to_timestamp(F.lit(f"{scope_start}T00:00:00Z")), tag("anomaly", F.concat(F.lit("starts-before-scope:"), F.col("event_id").cast("string")))),
    ))
    count = lambda df: df.groupBy("x.section", "x.name").agg(F.count(F.lit(1)).alias("value"))
    link = F.array(tag("total", F.lit("links")), F.when(F.col("listed_status") == "completed", tag("total", F.lit("completed"))).otherwise(tag("total", F.lit("non_completed"))))
    counts = count(events.select(F.explode(tags).alias("x"))).unionByName(count(discovered.select(F.explode(link).alias("x")))).unionByName(count(failed.select(F.explode(F.array(tag("total", F.lit("failed_discoveries")))).alias("x"))))
    fixed = [("total", n) for n in ("candidate_events", "unknown_events", "links", "completed", "non_completed", "failed_discoveries")] + [("included", f) for f in approved]
    out = _zero_filled(counts, fixed)
    spark = out.sparkSession
    out = out.unionByName(spark.createDataFrame([("total", "duplicate_links", float(duplicate_links))], "section string, name string, value double"))
    v = {(r["section"], r["name"]): r["value"] for r in out.where("section in ('total', 'included')").collect()}  # totals and families: a few rows
    total = lambda n: v["total", n]
    odd = [(f"no-events:{f}", 0.0) for f in approved if not v["included", f]] + [(f"expected-family-missing:{f}", 0.0) for f in expected if not v.get(("included", f))]
    odd += [("no-links", 0.0)] * (not total("links")) + [("duplicate-links-exceed-links", total("duplicate_links"))] * (0 < total("links") < total("duplicate_links"))
    odd += [("unknown-events-exceed-half", total("unknown_events"))] * (total("unknown_events") > total("candidate_events") / 2) + [("failed-discoveries", total("failed_discoveries"))] * bool(total("failed_discoveries"))
    return out.unionByName(spark.createDataFrame([("anomaly", n, x) for n, x in odd], "section string, name string, value double"))


#: The signals a feature table could use, in order: group, what covers them, of what, risk of leakage, whether
#: they are used. n: contests; events; legs: played legs; none: nothing that was known before a contest records them.
SIGNALS = {
    "team-record": ("team-history", "n", "n", "none", True),
    "recent-form": ("team-history", "n", "n", "none", True),
    "region-history": ("team-history", "region", "events", "none", True),
    "opponent-strength": ("team-history", "n", "n", "mitigated", True),
    "leg-history": ("map-history", "legs", "legs", "none", True),
    "attack-defense": ("map-history", "split", "legs", "none", True),
    "unknown-legs": ("map-history", "unknown", "legs", "none", True),
    "leg-selection": ("map-history", "none", "n", "high", False),
    "roster-continuity": ("roster-player", "both", "n", "none", True),
    "player-levels": ("roster-player", "any", "n", "none", True),
    "player-handles": ("roster-player", "none", "n", "none", False),
    "head-to-head": ("head-to-head", "n", "n", "none", True),
    "rest": ("schedule-rest", "n", "n", "none", True),
    "event-context": ("event-context", "n", "n", "none", True),
    "patch-version": ("event-context", "none", "n", "none", False),
    "home-region": ("event-context", "none", "n", "none", False),
}


def signal_coverage(c: DataFrame, events: DataFrame) -> DataFrame:
    """Per signal: how much of it is recorded, of what total, the missing share, the earliest time it can be used, whether it was
    known before a contest, its risk of leakage, and whether the feature table uses it. One aggregation over contests, one
    over events. c: ts, legs, roster_a, roster_b; events: event_id, region."""
    has = lambda n: F.coalesce(F.size(n) > 0, F.lit(False))
    legs = lambda f: F.coalesce(F.sum(F.size(F.filter("legs", f))), F.lit(0)).cast("long")
    played = lambda x: x["score_a"].isNotNull() & x["score_b"].isNotNull()
    one = c.agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), legs(played).alias("legs"), legs(lambda x: played(x) & x["attack_a"].isNotNull() & x["defense_a"].isNotNull()).alias("split"), legs(lambda x: played(x) & ~x["recognized"]).alias("unknown"),
        F.count_if(has("roster_a") & has("roster_b")).alias("both"), F.count_if(has("roster_a") | has("roster_b")).alias("any"),
    )
    two = events.agg(F.count_distinct("event_id").alias("events"), F.count_distinct(F.when(F.col("region").isNotNull(), F.col("event_id"))).alias("region"))
    t = one.join(F.broadcast(two)).withColumn("none", F.lit(0).cast("long"))  # one row each

    def row(name: str):
        group, covered, total, leakage, included = SIGNALS[name]
        missing = F.lit(0.0) if name == "unknown-legs" else F.coalesce(1 - F.try_divide(F.col(covered).cast("double"), F.col(total).cast("double")), F.lit(1.0 if name == "attack-defense" else 0.0))
        early = F.col("first") if covered != "none" else F.lit(None).cast("timestamp_ntz")
        return F.struct(F.lit(name).alias("signal"), F.lit(group).alias("signal_group"), F.col(covered).alias("covered"), F.col(total).alias("total"), missing.alias("missing_rate"), early.alias("earliest"), F.lit(covered != "none").alias("known_before"), F.lit(leakage).alias("leakage"), F.lit(included).alias("included"))

    return t.select(F.explode(F.array(*[row(n) for n in SIGNALS])).alias("x")).select("x.*")
