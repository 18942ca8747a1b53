"""Deterministic priority: queue, score, escalation and run health."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.cvss import cvss_band, cvss_letters, epss_band
from vulnspark.functions.text import blank, let, percent, present
from vulnspark.operators.attack import cve_vectors
from vulnspark.operators.evidence import reach_rank_of, scope_key, with_load_evidence, with_reach
from vulnspark.operators.generic import (
    count_when, distinct_when, first_per_key, latest, lookup, newest_verdicts, values_text, with_group,
)
from vulnspark.params import Params

# Score weights and tier cuts.
W_KEV = 45
W_EPSS = {"0": 0, "1": 8, "2": 20, "3": 30, "4": 40}
W_CVSS = {"": 0, "0": 0, "1": 8, "2": 16, "3": 22}
W_EXPOSURE = {"internet-facing": 25, "internal": 8, "isolated": 0}
W_EXPOSURE_UNKNOWN = 4
W_VERSION = {"yes": 22, "unknown": 4, "no": -25}
TIER_CUTS = ((85, "P0"), (65, "P1"), (45, "P2"), (25, "P3"))
TIERS = ("P0", "P1", "P2", "P3", "P4")


def weight(c: Column, table: Mapping[str, int], otherwise: int) -> Column:
    expr = F
    for k, v in table.items():
        expr = expr.when(c == k, v)
    return expr.otherwise(otherwise)


def tier(score: Column) -> Column:
    expr = F
    for cut, name in TIER_CUTS:
        expr = expr.when(score >= cut, name)
    return expr.otherwise("P4")


def tier_rank(c: Column) -> Column:
    return weight(c, {t: i for i, t in enumerate(TIERS)}, -1)


def rank_tier(c: Column) -> Column:
    expr = F
    for i, t in enumerate(TIERS[:4]):
        expr = expr.when(c == i, t)
    return expr.otherwise("P4")


def version_match(confidence: Column) -> Column:
    return F.when(confidence == "high", "yes").when(confidence == "informational", "no").otherwise("unknown")


def exposure_zone(rank: Column, words: Column) -> Column:
    r = F.coalesce(rank, F.lit(-9))
    return (F.when(r >= 3, "internet-facing").when(r >= 1, "internal").when(words == "no listening port", "isolated")
            .when(r == -1, "unknown").otherwise("internal"))


def t0_tier(kev: Column, cvss: Column, epss: Column, zone: Column, match: Column) -> Column:
    """Verdicts that need no analysis: P0 for exploited, exposed and confirmed; P4 for provably dull."""
    score, likely = F.coalesce(cvss, F.lit(0.0)), F.coalesce(epss, F.lit(0.0))
    facing = zone == "internet-facing"
    return (F.when((score < 4) & (likely * 1000 < 50) & ~kev & ~facing & (match == "no"), "P4")
            .when(kev & facing & (match == "yes") & (score >= 7), "P0"))


def priority_score(kev: Column, epss: Column, cvss: Column, zone: Column, match: Column) -> Column:
    """0 to 100 from measured facts only."""
    total = (F.when(kev, W_KEV).otherwise(0) + weight(epss_band(epss), W_EPSS, 0) + weight(cvss_band(cvss), W_CVSS, 0)
             + weight(F.lower(F.trim(blank(zone))), W_EXPOSURE, W_EXPOSURE_UNKNOWN)
             + weight(F.lower(F.trim(F.coalesce(match, F.lit("unknown")))), W_VERSION, 0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def signature(salt: str, cve: Column, severity: Column, kev: Column, cvss: Column, epss: Column, title: Column) -> Column:
    """Content signature of everything that may change a CVE's verdict; nothing per host enters."""
    return F.md5(F.concat_ws("|", F.lit(salt), blank(cve), F.lower(blank(severity)), F.when(kev, "1").otherwise("0"),
                             cvss_band(cvss), epss_band(epss), blank(title)))


def cve_scores(advisories: DataFrame) -> DataFrame:
    """Per CVE: the highest score, weaknesses, vector and the title a signature uses.

    The title is the smallest over 60 characters, else the smallest.
    """
    long_title = F.when(F.length("title") > 60, F.col("title"))
    return advisories.groupBy("cve_id").agg(
        F.max("cvss_score").alias("cvss_score"), F.coalesce(F.min(long_title), F.min("title")).alias("adv_title"))


def scored_inputs(findings: DataFrame, reach: DataFrame, advisories: DataFrame, p: Params) -> DataFrame:
    # Lookups by CVE first, then those by host, so that lookups by one key share its shuffle.
    rows = lookup(findings, cve_scores(advisories), ["cve_id"], ["cvss_score", "adv_title"])
    rows = rows.withColumn("rk_key", scope_key())
    rows = lookup(rows, reach, ["hostname", "rk_key"], ["reach_class", "reach_rank"])
    rows = rows.withColumns({
        "is_kev": present("kev_added"), "version_match": version_match(F.col("confidence")),
        "exposure_zone": exposure_zone(F.col("reach_rank"), F.col("reach_class")),
        "asset_criticality": F.lit(p.asset_criticality)})
    return rows.withColumn("t0_tier", t0_tier(
        F.col("is_kev"), F.col("cvss_score"), F.col("epss"), F.col("exposure_zone"), F.col("version_match")))


def candidate_queue(findings: DataFrame, reach: DataFrame, advisories: DataFrame, vendors: DataFrame, verdicts: DataFrame,
                    p: Params = Params()) -> DataFrame:
    """Every CVE waiting for analysis, most urgent first: worst finding per CVE, rule-decided and cached ones out."""
    rows = scored_inputs(findings, reach, advisories, p).filter("t0_tier is null")
    rows = rows.withColumn("sig_title", F.coalesce("adv_title", "title", F.lit("")))
    rows = rows.withColumn("sig", signature(p.signature_salt, F.col("cve_id"), F.col("severity"), F.col("is_kev"),
                                            F.col("cvss_score"), F.col("epss"), F.col("sig_title")))
    epss = F.coalesce("epss", F.lit(0.0))
    worst = first_per_key(rows.withColumn("_e", epss), ["cve_id"], F.col("is_kev").desc(), F.col("_e").desc(), "hostname", "finding_key")
    fresh = worst.join(verdicts.select("cve_id", "sig"), ["cve_id", "sig"], "left_anti")
    fresh = lookup(fresh, vendors, ["package"], ["vendor"])
    return fresh.orderBy(F.col("is_kev").desc(), F.col("_e").desc(), "cve_id").select(
        "cve_id", "sig", "severity", "cvss_score", "epss", "is_kev", F.col("sig_title").alias("cve_description"),
        F.col("package").alias("affected_product"), blank("vendor").alias("vendor"), F.col("hostname").alias("worst_asset"),
        "exposure_zone", "version_match", "confidence", "asset_criticality")


def triage_verdicts(queue: DataFrame, verdicts: DataFrame, budget: int) -> DataFrame:
    """Each queued CVE as a cache hit, to analyse, or deferred beyond the budget."""
    hits = verdicts.select("cve_id", "sig", F.lit(True).alias("_hit"))
    rows = queue.join(hits, ["cve_id", "sig"], "left")
    todo = rows.filter("_hit is null").orderBy(F.col("is_kev").desc(), F.col("epss").desc_nulls_last(), "cve_id").limit(budget)
    rows = rows.join(todo.select("cve_id").withColumn("_todo", F.lit(True)), "cve_id", "left")
    return rows.withColumn("route", F.when(F.col("_hit"), "cache").when(F.col("_todo"), "analyse").otherwise("deferred")).drop("_hit", "_todo")


# --- verdicts ---------------------------------------------------------------

# Closed vocabularies of a verdict.
EXPLOITABILITY = ("active-exploit", "proof-of-concept", "theoretical", "none")
EXPOSURE = ("internet-facing", "internal", "isolated")
PROCESS_MATCH = ("confirmed", "probable", "unlikely", "unknown")
ACTIONS = ("patch-now", "mitigate", "monitor", "accept", "risk-accept-with-compensation")
VERDICT_SCHEMA = (
    "priority_tier string, priority_score string, confidence string, rationale string, exploitability_signal string, "
    "exposure_signal string, process_match_confidence string, recommended_action string, "
    "recommended_mitigations array<string>, attck_techniques array<string>")


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "))


def validate_verdicts(raw: DataFrame, column: str = "answer") -> DataFrame:
    """Parse and check answer texts; ``problem`` is null for a usable verdict.

    A technique id that does not look like one is dropped, not a reason to
    reject the verdict.
    """
    v = F.from_json(column, VERDICT_SCHEMA)
    rows = raw.withColumn("_v", v)
    score, conf = F.col("_v.priority_score").try_cast("int"), F.col("_v.confidence").try_cast("double")
    none = F.array().cast("array<string>")
    text = clean_text(blank("_v.rationale"))

    def outside(name: str, allowed: tuple[str, ...]) -> Column:
        return ~F.coalesce(F.col(f"_v.{name}").isin(*allowed), F.lit(False))

    problem = (F.when(F.col("_v").isNull() | F.trim(F.col(column)).rlike(r"^[^{]"), "not an object")
               .when(outside("priority_tier", TIERS), "priority_tier must be one of " + "|".join(TIERS))
               .when(score.isNull(), "priority_score must be an integer")
               .when(~score.between(0, 100), "priority_score out of range")
               .when(conf.isNull(), "confidence must be a number").when(~conf.between(0.0, 1.0), "confidence out of range")
               .when(text == "", "rationale missing"))
    for name, allowed in (("exploitability_signal", EXPLOITABILITY), ("exposure_signal", EXPOSURE),
                          ("process_match_confidence", PROCESS_MATCH), ("recommended_action", ACTIONS)):
        problem = problem.when(outside(name, allowed), f"{name} must be one of " + "|".join(allowed))
    mitigations = F.filter(F.transform(F.coalesce("_v.recommended_mitigations", none), clean_text), lambda m: m != "")
    techniques = F.filter(F.coalesce("_v.attck_techniques", none), lambda t: t.rlike(r"^T\d{4}(\.\d{3})?$"))
    return rows.select(
        *raw.columns, problem.alias("problem"), F.col("_v.priority_tier").alias("model_tier"), score.alias("model_score"),
        F.round(conf, 3).alias("model_confidence"), text.alias("rationale"),
        *[F.col(f"_v.{c}").alias(c) for c in ("exploitability_signal", "exposure_signal", "process_match_confidence", "recommended_action")],
        mitigations.alias("recommended_mitigations"), techniques.alias("attck_techniques"))


# Wording of a claim of internet exposure, of its denial, and of each flag.
INTERNET_CLAIM = (r"(?i)internet[- ]facing|internet facing|exposed to the internet|publicly (?:accessible|exposed)"
                  r"|\breachable from the internet|from the internet")
NEGATORS = ("not ", "n't", "never", "no ", "non-", "unreachable", "unexposed", "isolated", "rather than", "instead of",
            "unlikely to be", "without")
NEGATION_WINDOW = 40
FLAG_EXPOSURE = "exposure_signal contradicts the measured exposure zone"
FLAG_PROSE = "the rationale calls this internet-facing and the measurement does not"
FLAG_KEV_OVER = "claims active exploitation with no KEV entry in evidence"
FLAG_KEV_UNDER = "calls a KEV-listed CVE unexploited"
FLAG_VERSION = "calls the process match confirmed where the installed version is NOT in the affected range"


def asserts_internet(text: Column) -> Column:
    """Whether any mention of internet exposure is claimed and not denied just before it.

    The text is split at each mention and read once from the front; a mention
    is judged by the characters just before it, all that is carried along.
    """
    def judge(value: Column) -> Column:
        found = F.regexp_extract_all(value, F.lit(f"({INTERNET_CLAIM})"), F.lit(1))
        pieces = F.split(value, INTERNET_CLAIM)
        parts = F.transform(found, lambda mention, i: F.struct(F.get(pieces, i).alias("text"), mention.alias("mention")))

        def after(state: Column, part: Column) -> Column:
            before = end_of(F.concat(state["tail"], part["text"]))
            return F.struct(end_of(F.concat(before, part["mention"])).alias("tail"), (state["claimed"] | ~denied(F.lower(before))).alias("claimed"))

        return F.aggregate(parts, F.struct(F.lit("").alias("tail"), F.lit(False).alias("claimed")), after, lambda state: state["claimed"])

    def end_of(value: Column) -> Column:
        return F.right(value, F.lit(NEGATION_WINDOW))

    def denied(window: Column) -> Column:
        test = F.lit(False)
        for word in NEGATORS:
            test = test | window.contains(word)
        return test

    return let(blank(text), judge)


def grounding_flags(verdicts: DataFrame) -> DataFrame:
    """Where a verdict contradicts a measured fact it was given, as an array of sentences."""
    zone, match = F.lower(F.trim(blank("exposure_zone"))), F.lower(F.trim(blank("version_match")))
    inside = zone.isin("internal", "isolated")
    signal = F.col("exploitability_signal")
    kev = F.col("is_kev")
    flags = F.array_compact(F.array(
        F.when(inside & (F.col("exposure_signal") == "internet-facing"), FLAG_EXPOSURE),
        F.when(inside & asserts_internet(F.col("rationale")), FLAG_PROSE),
        F.when((match == "no") & (F.col("process_match_confidence") == "confirmed"), FLAG_VERSION),
        F.when(kev & signal.isin("theoretical", "none"), FLAG_KEV_UNDER),
        F.when(~kev & (signal == "active-exploit"), FLAG_KEV_OVER)))
    return verdicts.withColumn("grounding", flags)


def grounding_rate(verdicts: DataFrame) -> DataFrame:
    """Checked and flagged verdicts, and each reason's count; unchecked rows count in neither half."""
    checked = verdicts.filter("grounding is not null")
    totals = checked.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.size("grounding") > 0).alias("flagged"))
    reasons = checked.select(F.explode("grounding").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return reasons.withColumns({"checked": totals.select("checked").scalar(), "flagged": totals.select("flagged").scalar()})


# --- expansion and escalation -----------------------------------------------

# Facts a rule may name, and those nothing produces.
FACTS = ("esc_attack_vector", "esc_impact_c", "esc_impact_i", "esc_impact_a", "esc_reach_rank", "esc_load_rank",
         "esc_eol_support", "esc_has_fix")
UNPRODUCED_FACTS = ("esc_sole_listener", "esc_root_autorun_writable", "esc_route_evidence")

#: The two rules every replay evaluates; neither is enabled by default.
SHIPPED_RULES = {
    "listener_loads_the_library": "esc_load_rank = 3 AND esc_reach_rank < 1",
    "no_supported_release_no_fix": "esc_eol_support = 'no supported release' AND esc_has_fix = 0",
}


def escalation_facts(findings: DataFrame, reach: DataFrame, coverage: DataFrame, loaded: DataFrame, links: DataFrame,
                     eol: DataFrame, advisories: DataFrame) -> DataFrame:
    """The eight measured facts a rule may use."""
    rows = with_reach(findings.drop("reach_class", "reach_rank"), reach, coverage)
    rows = rows.withColumn("esc_reach_rank", reach_rank_of(F.col("reach_class")))
    rows = with_load_evidence(rows, loaded, links).withColumnRenamed("load_rank", "esc_load_rank")
    # By host and package, as components are placed when their support is known; the paths a host has a package at are few.
    paths = eol.filter("path IS NOT NULL").groupBy("hostname", "package").agg(F.collect_list(F.struct("path", "support")).alias("_paths"))
    rows = lookup(rows, paths, ["hostname", "package"], ["_paths"])
    rows = rows.withColumn("esc_eol_support", F.get(F.filter("_paths", lambda p: p["path"] == F.col("path")), F.lit(0))["support"]).drop("_paths")
    rows = lookup(rows, cve_vectors(advisories), ["cve_id"], {"cvss_vector": "_vec"})
    letters = cvss_letters(F.col("_vec"))
    return rows.withColumns({
        "esc_eol_support": blank("esc_eol_support"), "esc_has_fix": present("fixed_version").cast("int"),
        "esc_attack_vector": blank(letters["av"]), "esc_impact_c": blank(letters["c"]), "esc_impact_i": blank(letters["i"]),
        "esc_impact_a": blank(letters["a"])}).drop("_vec", "load_class", "loaders", "loader_count", "loaded_listening")


def check_rules(rules: Mapping[str, str]) -> None:
    """Refuse a rule that names a fact nothing measures."""
    import re

    for name, text in rules.items():
        named = set(re.findall(r"\besc_[a-z_]+\b", text))
        if not named:
            raise ValueError(f"rule {name} names no fact")
        unknown = named - set(FACTS)
        if unknown:
            raise ValueError(f"rule {name} names facts nothing produces: {sorted(unknown)}")


def matched_rules(rules: Mapping[str, str]) -> Column:
    """Names of the rules that are definitely true; a null fact never fires one."""
    check_rules(rules)
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.expr(text), F.lit(name)) for name, text in rules.items()]))


def escalated_rank(rank: Column, hit: Column, p: Params) -> Column:
    """The tier rank after at most the capped bump, never above the floor tier."""
    floor = TIERS.index(p.escalation_floor)
    return F.when(hit & (rank > floor), F.greatest(rank - p.escalation_cap, F.lit(floor))).otherwise(rank)


def apply_rules(df: DataFrame, rules: Mapping[str, str], p: Params = Params()) -> DataFrame:
    """Escalate scored rows one tier where an enabled rule fires; rule-decided rows are left alone."""
    rows = df.withColumn("_hits", matched_rules(rules)).withColumn("deterministic_tier", F.col("priority_tier"))
    rank = tier_rank(F.col("priority_tier"))
    hit = (F.size("_hits") > 0) & (F.col("from_t0") == 0)
    rows = rows.withColumn("_to", escalated_rank(rank, hit, p)).withColumns({
        "escalated": (F.col("_to") != rank).cast("int"), "escalation_rules": F.array_join("_hits", " ")})
    floor_score = weight(rank_tier(F.col("_to")), {t: cut for cut, t in TIER_CUTS}, 0)
    up = F.col("escalated") == 1
    return rows.withColumns({
        "priority_tier": F.when(up, rank_tier(F.col("_to"))).otherwise(F.col("priority_tier")),
        "priority_score": F.when(up, F.greatest("priority_score", floor_score)).otherwise(F.col("priority_score")),
    }).drop("_hits", "_to")


def score_findings(findings: DataFrame, verdicts: DataFrame, reach: DataFrame, advisories: DataFrame, now: int,
                   p: Params = Params()) -> DataFrame:
    """Score and tier per finding: a rule's verdict, or the CVE's base score adjusted for this host."""
    fields = {"priority_tier": "_tier", "priority_score": "_base", "analysed_at": "_at", "confidence": "_conf",
              "rationale": "_why", "recommended_action": "_action", "analysis_source": "_src"}
    rows = lookup(findings, newest_verdicts(verdicts), ["cve_id"], {c: n for c, n in fields.items() if c in verdicts.columns})
    rows = scored_inputs(rows, reach, advisories, p)
    stale = F.coalesce(F.col("_at") < now - p.verdict_stale, F.lit(True))
    adjust = (weight(F.col("exposure_zone"), {"internal": -5, "isolated": -15}, 0)
              + weight(F.col("version_match"), {"yes": 10, "unknown": -5, "no": -25}, 0)
              + weight(F.col("asset_criticality"), {"high": 5, "low": -5}, 0))
    from_t0 = F.col("t0_tier").isNotNull()
    score = F.when(F.col("t0_tier") == "P0", 95).when(from_t0, 10).otherwise(
        F.least(F.greatest(F.coalesce(F.col("_base"), F.lit(50)) + adjust, F.lit(0)), F.lit(100)))
    rows = rows.withColumns({"from_t0": from_t0.cast("int"), "scored": (
        from_t0 | (F.col("_tier").isNotNull() & ~stale)).cast("int"), "priority_score": score})
    return rows.withColumn("priority_tier", F.when(from_t0, F.col("t0_tier")).otherwise(tier(F.col("priority_score"))))


def expand_verdicts(findings: DataFrame, verdicts: DataFrame, reach: DataFrame, coverage: DataFrame, loaded: DataFrame,
                    links: DataFrame, eol: DataFrame, advisories: DataFrame, now: int,
                    rules: Mapping[str, str] | None = None, p: Params = Params()) -> DataFrame:
    """Prioritised findings: scored, escalated and explained."""
    rows = score_findings(findings, verdicts, reach, advisories, now, p).filter("scored = 1")
    rows = escalation_facts(rows, reach, coverage, loaded, links, eol, advisories)
    rows = apply_rules(rows, rules or {}, p)
    why = F.coalesce("_why", F.concat(F.lit("Deterministic rule: "), "deterministic_tier", F.lit(".")))
    moved = F.concat(why, F.lit(" Escalated one tier, "), "deterministic_tier", F.lit(" to "), "priority_tier",
                     F.lit(", by escalation rule: "), "escalation_rules", F.lit("."))
    rows = rows.select(
        "finding_key", "cve_id", F.col("hostname").alias("asset_id"), "package", "ecosystem", "path", "severity", "epss", "title",
        F.when(F.col("is_kev"), "true").otherwise("false").alias("kev"), "exposure_zone", "version_match", "asset_criticality",
        "priority_tier", "priority_score", "deterministic_tier", "escalated", "escalation_rules",
        F.when(F.col("from_t0") == 1, "T0").otherwise(F.coalesce("_src", F.lit("model"))).alias("analysis_source"),
        F.coalesce("_at", F.lit(now).cast("bigint")).alias("analysed_at"),
        F.coalesce("_conf", F.when(F.col("from_t0") == 1, 0.9).otherwise(0.0)).alias("confidence"),
        F.when(F.col("escalated") == 1, moved).otherwise(why).alias("rationale"),
        F.coalesce("_action", F.lit("monitor")).alias("recommended_action"))
    return with_group(rows, ["cve_id"], F.count_distinct("asset_id").alias("cve_asset_count"))


def replay_rules(facts: DataFrame, rules: Mapping[str, str], enabled: tuple[str, ...] = (), p: Params = Params()) -> DataFrame:
    """Blast radius of each rule on its own: findings, hosts and CVEs per tier move."""
    rank = tier_rank(F.col("priority_tier"))
    would = (F.col("scored") == 1) & (F.col("from_t0") == 0) & (rank > TIERS.index(p.escalation_floor))
    rows = facts.withColumn("rule", F.explode(matched_rules(rules))).withColumns({
        "from_tier": F.when(F.col("scored") == 1, F.col("priority_tier")).otherwise("unscored"),
        "to_tier": F.when(would, rank_tier(escalated_rank(rank, F.lit(True), p))).otherwise("no change"),
        "enabled": F.when(F.col("rule").isin(*enabled), "yes").otherwise("no") if enabled else F.lit("no")})
    return rows.groupBy("rule", "enabled", "from_tier", "to_tier").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("hostname").alias("hosts"), F.count_distinct("cve_id").alias("cves"))


def mutate(df: DataFrame, fact: str) -> DataFrame:
    """The same rows with one fact unknown; a rule written about it must stop firing."""
    if fact not in FACTS:
        raise ValueError(f"{fact} is not a fact, so mutating it would prove nothing")
    return df.withColumn(fact, F.lit(None).cast(df.schema[fact].dataType))


def rescoring_guard(results: DataFrame) -> DataFrame:
    """One row when the newest run escalated more than 5 % of findings or 33 % of alerting ones."""
    top = F.col("priority_tier").isin("P0", "P1")
    up = F.col("escalated") == 1
    out = results.agg(
        F.count(F.lit(1)).alias("findings"), count_when(up).alias("bumped"), count_when(top).alias("alerting"),
        count_when(up & top).alias("alerting_bumped"), values_text(F.when(up, F.col("escalation_rules")), "; ").alias("rules_firing"))
    out = out.withColumns({
        "bumped_share": percent(F.col("bumped"), F.col("findings")),
        "alerting_bumped_share": F.coalesce(percent(F.col("alerting_bumped"), F.col("alerting")), F.lit(0.0))})
    return out.filter("findings > 0 and (bumped_share > 5 or alerting_bumped_share > 33)")


def epss_bands(findings: DataFrame) -> DataFrame:
    """Distinct CVEs per EPSS band, in one row."""
    band = epss_band(F.col("epss"))
    return findings.agg(*[distinct_when(band == b, "cve_id").alias(f"sea_{b}") for b in "01234"])


def overview(results: DataFrame, findings: DataFrame, now: int) -> DataFrame:
    row = results.agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("cve_id").alias("cves"), F.count_distinct("asset_id").alias("assets"),
        *[count_when(F.col("priority_tier") == t).alias(t.lower()) for t in TIERS], F.max("analysed_at").alias("latest_at"))
    bands = epss_bands(findings)
    return row.withColumns({c: bands.select(c).scalar() for c in bands.columns}).withColumn("computed_at", F.lit(now).cast("bigint"))


def alerts(results: DataFrame) -> DataFrame:
    return results.filter(F.col("priority_tier").isin("P0", "P1"))


def results_stopped(results: DataFrame, since: int) -> DataFrame:
    """One row when nothing arrived since a time."""
    return results.filter(F.col("result_at") >= since).agg(F.count(F.lit(1)).alias("results")).filter("results = 0")


def latest_results(results: DataFrame) -> DataFrame:
    """The newest result per CVE and asset, from complete runs only."""
    rows = with_group(results, ["run_id"], F.max("result_at").alias("_run")).filter(F.col("result_at") >= F.col("_run") - 1)
    fields = [c for c in ("priority_tier", "priority_score", "confidence", "rationale", "recommended_action", "analysis_source",
                          "exposure_zone", "epss", "kev", "severity", "run_id") if c in results.columns]
    return rows.groupBy("cve_id", "asset_id").agg(*[latest(c, "result_at").alias(c) for c in fields],
                                                  F.max("result_at").alias("analysed_at"))


def newest_run(results: DataFrame) -> DataFrame:
    newest = results.agg(F.max("result_at")).scalar()
    return results.filter(F.col("result_at") >= newest - 1)


def drop_dead_verdicts(verdicts: DataFrame, state: DataFrame) -> DataFrame:
    """Verdicts whose CVE still has an open finding; unsigned rows are kept."""
    alive = state.filter("status = 'open'").select("cve_id").distinct()
    return verdicts.filter(~present("sig")).unionByName(verdicts.filter(present("sig")).join(alive, "cve_id", "left_semi"))


def run_tally(results: DataFrame) -> DataFrame:
    src = F.col("analysis_source")
    out = results.agg(
        F.count(F.lit(1)).alias("rows"), count_when(src == "deferred").alias("deferred"), count_when(src == "T2").alias("model_calls"),
        count_when(src == "fallback").alias("fallbacks"), count_when(src == "cache").alias("cache_hits"))
    out = out.withColumn("verdicts", F.col("model_calls") + F.col("fallbacks") + F.col("cache_hits"))
    return out.withColumn("unclassified", F.col("rows") - F.col("verdicts") - F.col("deferred"))
