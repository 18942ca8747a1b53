"""Local evidence about findings: ports, containers, loads, support, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import base_name, blank, day_epoch, empty_to_null, extract, null_like_columns, package_from_purl, present
from vulnspark.operators.generic import (
    carry_forward, distinct_when, lookup, lookup_fallback, newest_rows, set_size, values, values_text,
)
from vulnspark.operators.identity import optional
from vulnspark.params import Params
from vulnspark.sources.state import written

# Reach ranks and their wording.
REACH_WORDS = ((3, "answers any address"), (2, "answers one address"), (1, "loopback only"), (0, "no listening port"))
BIND_RANK = (("wildcard", 3), ("specific", 2), ("loopback", 1))
EXPOSURE_NULLABLE = ["address", "bind_scope", "executable", "unit", "user", "purl", "container_id", "container_name",
                     "confidence", "os_component"]
LINKED_TYPES = ("deb", "rpm", "apk", "binary", "windows")


def endpoint() -> Column:
    return F.concat("address", F.lit(":"), F.col("port").cast("string"), F.lit("/"), "protocol")


def text_safe(c: Column) -> Column:
    """Chain separators inside a name are replaced."""
    return F.translate(c, "|;", "__")


def reach_class_of(rank: Column, otherwise: str) -> Column:
    expr = F
    for value, words in REACH_WORDS:
        expr = expr.when(rank >= value if value else rank == 0, words)
    return expr.otherwise(otherwise)


def reach_rank_of(words: Column) -> Column:
    expr = F
    for value, name in REACH_WORDS:
        expr = expr.when(words == name, value)
    return expr.otherwise(-1)


def scope_key(scope_id: Column | str = "scope_id", package: Column | str = "package") -> Column:
    """What reachability is keyed by: the short container id, else the package."""
    scope = blank(scope_id)
    package = F.col(package) if isinstance(package, str) else package
    return F.when(scope.startswith("container:"),
                  F.concat(F.lit("container:"), F.substring(scope, 11, 12))).otherwise(package)


def listening_ports(exposure: DataFrame, old: DataFrame, hoststate: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    """The newest listening ports of every host."""
    rows = null_like_columns(newest_rows(exposure, ["hostname"], "scanned_at"), EXPOSURE_NULLABLE)
    rows = rows.withColumns({
        "package": package_from_purl("purl"),
        "held_by_os": F.when(F.col("os_component") == "true", 1).otherwise(0),
        "package_key": F.coalesce(package_from_purl("purl"), F.lit("unattributed"))})
    return carry_forward(rows, old, "scanned_at", ["hostname", "port", "protocol", "package_key"], hoststate, now,
                         p.host_retire_days)


def containers(records: DataFrame, old: DataFrame, hoststate: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    """The newest containers of every host, with their published endpoints."""
    fields = ["container_name", "runtime", "state", "image_ref", "image_digest", "os_id", "os_version_id"]
    rows = null_like_columns(newest_rows(records, ["hostname"], "scanned_at"), fields)
    public = F.filter("endpoints", lambda e: ~e.rlike(r"^(127\.|\[::1\])"))
    rows = rows.withColumns({
        "container_short": F.substring("container_id", 1, 12),
        "endpoints_text": F.array_join("endpoints", ";"), "declared_text": F.array_join("declared_endpoints", ";"),
        "n_endpoints": F.coalesce(F.cardinality("endpoints"), F.lit(0)),
        "n_public_endpoints": F.coalesce(F.cardinality(public), F.lit(0))})
    rows = rows.drop("endpoints", "declared_endpoints")
    return carry_forward(rows, old, "scanned_at", ["hostname", "container_id"], hoststate, now, p.host_retire_days)


def reach(exposure: DataFrame, now: int) -> DataFrame:
    """Reachability per host and package or container."""
    rank = F
    for scope, value in BIND_RANK:
        rank = rank.when(F.col("bind_scope") == scope, value)
    short = F.substring(blank("container_id"), 1, 12)
    exe = base_name(blank("executable"))
    listener = text_safe(F.coalesce("unit", empty_to_null(exe), F.lit("unidentified listener")))
    cname = text_safe(blank("container_name"))
    rows = exposure.withColumns({
        "rk_key": F.when(short != "", F.concat(F.lit("container:"), short)).otherwise(F.col("package")),
        "_rank": rank.otherwise(-1), "_ep": endpoint(), "_li": listener, "_co": cname})
    rows = rows.filter(present("rk_key"))
    return rows.groupBy("hostname", "rk_key").agg(
        F.max("_rank").alias("reach_rank"), F.max("scanned_at").alias("exposure_scanned_at"),
        F.count_distinct("_ep").alias("listeners"), values_text("_ep").alias("ports_text"),
        values_text("_li").alias("listener_text"), values_text("_co").alias("container_text"),
        values_text(F.concat_ws("|", "_ep", "_li", "_co"), ";").alias("chain_text"),
        values_text("executable").alias("listener_path_text"), values_text("package").alias("package"),
        values_text(blank("container_id")).alias("container_id"),
    ).withColumns({"reach_class": reach_class_of(F.col("reach_rank"), "no listening port"),
                   "rolled_at": F.lit(now).cast("bigint")})


def exposure_coverage(exposure: DataFrame) -> DataFrame:
    """What the port scan could and could not attribute, per host."""
    bare = ~present("package")
    held = F.col("held_by_os") == 1
    rows = exposure.withColumn("_ep", endpoint())

    def when(test: Column) -> Column:
        return F.when(test, F.col("_ep"))

    return rows.groupBy("hostname").agg(
        set_size("_ep").alias("listeners"),
        set_size(when(F.col("bind_scope") == "wildcard")).alias("wildcard_listeners"),
        set_size(when(bare & ~held)).alias("unattributed_listeners"),
        set_size(when(bare & held)).alias("os_listeners"),
        set_size("package").alias("packages_behind_ports"),
        set_size("container_name").alias("containers"), F.max("scanned_at").alias("assessed_at"))


def _link_rows(links: DataFrame) -> DataFrame:
    rows = newest_rows(links, ["hostname"], "scanned_at")
    rows = null_like_columns(rows, ["executable", "executable_purl", "purl", "path", "soname", "container_id"])
    return rows.withColumns({"package": package_from_purl("purl"),
                             "listening": F.col("listening").cast("string").isin("true", "1").cast("int")})


def loaded_libraries(links: DataFrame, old: DataFrame, hoststate: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    """Which packages a running process loads, listeners first."""
    rows = _link_rows(links)
    short = F.substring(blank(optional(rows, "container_id")), 1, 12)
    root = F.coalesce(optional(rows, "root"), F.when(short != "", F.concat(F.lit("container:"), short)).otherwise("/"))
    owner = F.split_part(package_from_purl(optional(rows, "executable_purl")), F.lit("/"), F.lit(-1))
    loader = text_safe(F.coalesce(owner, empty_to_null(base_name(blank("executable"))), F.lit("unidentified binary")))
    rows = rows.filter(present("package")).withColumns({
        "scope_key": F.when(root == "/", F.col("package")).otherwise(root), "_loader": loader})
    out = rows.groupBy("hostname", "scope_key", "package").agg(
        F.max("listening").alias("loaded_listening"), F.count_distinct("_loader").alias("loader_count"),
        values(F.when(F.col("listening") == 1, F.col("_loader"))).alias("_lis"), values("_loader").alias("_all"),
        F.max("scanned_at").alias("scanned_at"))
    out = out.select(
        "hostname", "scope_key", "package",
        F.when(F.col("loaded_listening") == 1, "a listener loads it").otherwise("loaded, not listening").alias("load_class"),
        F.when(F.col("loaded_listening") == 1, 3).otherwise(2).alias("load_rank"),
        F.array_join(F.array_distinct(F.concat("_lis", "_all")), ", ").alias("loaders"),
        "loader_count", "loaded_listening", "scanned_at")
    return carry_forward(out, old, "scanned_at", ["hostname", "scope_key", "package"], hoststate, now, p.host_retire_days)


def link_coverage(links: DataFrame, old: DataFrame, hoststate: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    """How much of each host's library use is attributed to a package."""
    rows = _link_rows(links)
    os_held = F.col("os_component").cast("string").isin("true", "1")
    unowned = F.col("path").isNotNull() & ~present("package") & ~F.coalesce(os_held, F.lit(False))
    out = rows.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("link_rows"), F.count_distinct("package").alias("linked_packages"),
        distinct_when(F.col("listening") == 1, "executable").alias("listening_loaders"),
        distinct_when(unowned, F.coalesce("path", "soname")).alias("unowned_libraries"),
        F.max("scanned_at").alias("assessed_at"))
    return carry_forward(out, old, "assessed_at", ["hostname"], hoststate, now, p.host_retire_days)


def with_load_evidence(findings: DataFrame, loaded: DataFrame, links: DataFrame) -> DataFrame:
    """Whether the vulnerable library is loaded, in four honest classes."""
    scope = blank("scope_id")
    # By host first: findings that come from a lookup by host (with_reach) need no shuffle for it; written, as there.
    hosts = written(links.select("hostname", "link_rows", "assessed_at"), "links")
    rows = lookup(findings, hosts, ["hostname"], {"link_rows": "_rows", "assessed_at": "loads_assessed_at"})
    rows = rows.withColumn("_scope", F.when(scope.isin("", "/"), F.col("package")).otherwise(scope))
    rows = lookup(rows, loaded, {"hostname": "hostname", "_scope": "scope_key", "package": "package"},
                  {c: f"_l_{c}" for c in ("load_class", "load_rank", "loaders", "loader_count", "loaded_listening")})
    words = F.when(F.col("_l_load_class").isNotNull(), F.col("_l_load_class")).when(
        ~F.coalesce(F.col("ecosystem").isin(*LINKED_TYPES), F.lit(False)), "not a linked library").when(
        F.coalesce("_rows", F.lit(0)) == 0, "not assessed").otherwise("not in the load list")
    rows = rows.withColumn("load_class", words)
    return rows.withColumns({
        "load_rank": F.coalesce("_l_load_rank", F.when(F.col("load_class") == "not in the load list", 1).otherwise(0)),
        "loaders": F.col("_l_loaders"), "loader_count": F.col("_l_loader_count"),
        "loaded_listening": F.coalesce("_l_loaded_listening", F.lit(0)),
    }).drop("_scope", "_rows", *[f"_l_{c}" for c in ("load_class", "load_rank", "loaders", "loader_count", "loaded_listening")])


def normal_product(name: Column) -> Column:
    """A package name reduced to the product a lifecycle catalogue lists."""
    out = F.regexp_replace(F.lower(blank(name)), "^lib", "")
    out = F.regexp_replace(out, "^(python3?|golang|node|perl|ruby|rust)-", "")
    out = F.regexp_replace(out, "[ _-]?[0-9][0-9.]*$", "")
    return F.regexp_replace(out, "[^a-z0-9+.]", "")


CYCLE_FIELDS = ("cycle", "eol_from", "eoes_from", "label", "category", "latest")


def support_lifecycle(latest_rows: DataFrame, lifecycle: DataFrame, exposure: DataFrame, config: DataFrame,
                      state: DataFrame, now: int) -> DataFrame:
    """Vendor support of installed software, with the evidence that it runs.

    The release is looked up by three, two and then one version number.
    """
    rows = latest_rows.filter(blank("role") == "") if "role" in latest_rows.columns else latest_rows
    v = F.regexp_replace(blank("version"), "^[^0-9]*", "")
    rows = rows.withColumns({
        "product": normal_product(F.col("name")), "ecosystem": F.lower(blank("type")),
        "_v1": extract(v, r"^(\d+)"), "_v2": extract(v, r"^(\d+\.\d+)"), "_v3": extract(v, r"^(\d+\.\d+\.\d+)")})
    rows = rows.withColumns({f"_k{i}": F.concat("product", F.lit("|"), f"_v{i}") for i in (1, 2, 3)})
    # Written first: its size is known, so a small catalogue is not met by moving every component to its few keys,
    # and a large one is joined with parts of a key that many components (or those without a number) share.
    table = written(lifecycle.withColumn("_key", F.concat("product", F.lit("|"), "cycle")), "lifecycle")
    fields = [c for c in CYCLE_FIELDS if c in table.columns]
    rows = lookup_fallback(rows, table, ["_k3", "_k2", "_k1"], "_key", fields).filter("cycle is not null")
    rows = rows.withColumn("_os", F.concat(F.lower(blank("os_id")), F.lit("|"), blank("os_version_id")))
    rows = lookup(rows, table, {"_os": "_key"}, {"eol_from": "_os_eol"})

    past = F.coalesce(day_epoch("eol_from") < now, F.lit(False))
    distro = F.col("ecosystem").isin("deb", "rpm", "apk")
    os_end = day_epoch("_os_eol")
    support = (F.when(~past, "supported")
               .when(F.lower(blank("version")).rlike("esm|fips"), "vendor extended support")
               .when(distro & (os_end > now), "supported by the distribution")
               .when(distro & os_end.isNull(), "distribution lifecycle unknown")
               .otherwise("no supported release"))
    rows = rows.withColumns({"past_eol": past.cast("int"), "support": support})
    rung = F.when(F.lower(blank("bind_scope")) == "loopback", 2).otherwise(1)
    ports = exposure.filter(present("package")).groupBy("hostname", F.col("package").alias("name")).agg(F.min(rung).alias("_listen"))
    conf = config.withColumn("name", extract("purl", "/([^/@]+)@")).filter("name is not null").groupBy("hostname", "name").agg(
        values_text("kind").alias("_kinds"))
    rows = lookup(rows, ports, ["hostname", "name"], ["_listen"])
    rows = lookup(rows, conf, ["hostname", "name"], ["_kinds"])
    rows = rows.withColumn("rung", F.coalesce("_listen", F.when(F.col("_kinds").isNotNull(), 4), F.lit(5)))
    rows = rows.withColumns({
        "confidence": F.when(F.col("support") == "no supported release", "high").when(
            F.col("support") == "supported", "supported").otherwise("informational"),
        "reach": F.when(F.col("rung") == 1, "listening on a routable address").when(
            F.col("rung") == 2, "listening on loopback only").when(
            F.col("rung") == 4, F.concat(F.lit("configured to run: "), "_kinds")).otherwise(
            "installed only, nothing observed it run"),
        "assessed_at": F.lit(now).cast("bigint")})
    accepted = state.filter("accepted = '1'").select("hostname", F.col("package").alias("name")).distinct()
    rows = rows.join(accepted, ["hostname", "name"], "left_anti")
    return rows.select("hostname", F.col("name").alias("package"), "version", *[c for c in fields], "product", "path",
                       "root", "ecosystem", "support", "confidence", "reach", "rung", "past_eol", "assessed_at")


def product_line() -> Column:
    return F.concat(F.coalesce("label", "product"), F.lit(" "), "cycle")


def eol_horizon(eol: DataFrame, months: float, now: int) -> DataFrame:
    """Product lines whose support ends inside the horizon, soonest first."""
    at = day_epoch("eol_from")
    rows = eol.withColumns({"eol_at": at, "days": F.round((at - now) / F.lit(86400.0)).cast("bigint"), "product_line": product_line()})
    rows = rows.filter(F.col("days") <= 30.44 * months)
    return rows.groupBy("product_line").agg(
        F.min("eol_at").alias("eol_at"), F.min("days").alias("days"), F.count_distinct("hostname").alias("hosts")
    ).withColumn("state", F.when(F.col("days") < 0, "overdue").otherwise("supported"))


def eol_list(eol: DataFrame, line: str | None = None) -> DataFrame:
    rows = eol.withColumn("product_line", product_line())
    rows = rows if line is None else rows.filter(F.col("product_line") == line)
    return rows.withColumn("support_ends", F.coalesce(empty_to_null("eol_from"), F.lit("not stated")))


def eol_products(eol: DataFrame) -> DataFrame:
    rows = eol.filter(present("eol_from")).withColumn("product_line", product_line())
    return rows.groupBy("product_line").agg(F.count(F.lit(1)).alias("count"))


def with_reach(findings: DataFrame, reach_table: DataFrame, coverage: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Reach class and rank; a host never scanned for ports is "not assessed", never "not reachable".

    A column ``rk_key`` that the findings have is taken for their :func:`scope_key`.
    """
    rows = findings if "rk_key" in findings.columns else findings.withColumn("rk_key", scope_key())
    rows = lookup(rows, reach_table, ["hostname", "rk_key"], {"reach_class": "_rc", **{c: c for c in extra}})
    # Written first, so that its size is known: a table of hosts that is small is not met by moving every finding to its host.
    rows = lookup(rows, written(coverage.select("hostname", "assessed_at"), "coverage"), ["hostname"], {"assessed_at": "_seen"})
    words = F.coalesce("_rc", F.when(F.col("_seen").isNull(), "not assessed").otherwise("no listening port"))
    rows = rows.withColumn("reach_class", words).drop("_rc", "_seen")
    return rows.withColumn("reach_rank", reach_rank_of(F.col("reach_class")))


def triage(findings: DataFrame, reach_table: DataFrame, coverage: DataFrame) -> DataFrame:
    """Reach and exploit classes and the triage tier they give."""
    rows = with_reach(findings, reach_table, coverage, ("ports_text", "listener_text", "chain_text"))
    kev = present("kev_added")
    epss = F.col("epss")
    rows = rows.withColumns({
        "is_kev": kev.cast("int"),
        "exploit_class": F.when(kev, "KEV").when(epss >= 0.5, "EPSS 50%+").when(epss >= 0.1, "EPSS 10-50%").when(
            epss >= 0.01, "EPSS 1-10%").when(epss.isNotNull(), "EPSS under 1%").otherwise("unscored"),
        "exploit_rank": F.when(kev, 5).when(epss >= 0.5, 4).when(epss >= 0.1, 3).when(epss >= 0.01, 2).when(
            epss.isNotNull(), 1).otherwise(0)})
    r, e = F.col("reach_rank"), F.col("exploit_rank")
    return rows.withColumn("tier", F.when(r == -1, "unknown-risk").when(
        (r >= 2) & ((e >= 3) | (e == 0)), "act-now").when(r >= 2, "act-soon").when(
        (r == 1) & (e >= 4), "act-soon").when(e >= 4, "plan").otherwise("watch"))


def exposure_chain(triaged: DataFrame) -> DataFrame:
    """Hops edge, listener, container, package, CVE of every reachable finding."""
    rows = triaged.filter((F.col("reach_rank") >= 1) & present("chain_text"))
    rows = rows.withColumn("_hop", F.explode(F.split("chain_text", ";"))).withColumn("_hop", F.split("_hop", r"\|"))
    edge, proc, cont = (F.get("_hop", F.lit(i)) for i in range(3))
    proc_kind = F.when(proc == "", "listener-unknown").otherwise("listener")
    proc = F.when(proc == "", "unidentified listener").otherwise(proc)
    cve_kind = F.when(F.col("is_kev") == 1, "cve-kev").otherwise("cve")

    def hop(a: Column, ak: Column, b: Column, bk: Column) -> Column:
        return F.struct(a.alias("source"), ak.alias("source_kind"), b.alias("target"), bk.alias("target_kind"))

    package, cve = F.col("package"), F.col("cve_id")
    pk = F.lit("package")
    inside = F.array(hop(proc, proc_kind, cont, F.lit("container")), hop(cont, F.lit("container"), package, pk))
    direct = F.array(hop(proc, proc_kind, package, pk))
    hops = F.concat(F.array(hop(edge, F.lit("edge"), proc, proc_kind)),
                    F.when(blank(cont) == "", direct).otherwise(inside),
                    F.array(hop(package, pk, cve, cve_kind)))
    return rows.withColumn("_h", F.explode(hops)).select("hostname", "cve_id", "package", "_h.*")


def container_findings(findings: DataFrame, containers_table: DataFrame) -> DataFrame:
    """Findings inside containers with the publish state and tier of the container."""
    rows = findings.filter("scope = 'container'").withColumn(
        "container_short", F.regexp_replace("scope_id", "^container:", ""))
    rows = lookup(rows, containers_table, ["hostname", "container_short"], [
        "container_name", "state", "runtime", "image_ref", "image_digest", "endpoints_text", "declared_text",
        "n_endpoints", "n_public_endpoints"])
    stopped = F.col("state") != "running"
    declared = F.coalesce("n_endpoints", F.lit(0)) > 0
    public = F.coalesce("n_public_endpoints", F.lit(0)) > 0
    rows = rows.withColumn("published", F.when(stopped & declared, "declares a port").when(
        stopped, "no declared port").when(public, "publishes a port").when(
        declared, "loopback only").otherwise("no published port"))
    return rows.withColumns({
        "container_label": F.coalesce("container_name", "container_short"),
        "image_label": F.coalesce("image_ref", F.lit("unknown image")),
        "ctr_tier": F.when(stopped, "4. stopped, still vulnerable").when(
            F.col("published") == "publishes a port", "1. running and published").when(
            F.col("published") == "loopback only", "2. running, loopback only").otherwise("3. running, not published")})
