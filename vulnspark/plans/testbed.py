"""Domain tables derived from the given star-schema tables.

Each table is one SQL text in the dialect Spark and DuckDB share, so the
same rows feed the operators and the oracle. ``b_name`` is a given table,
``t_name`` a derived one; ``@EPOCH(x)`` is seconds since 1970. The whole
given tables are read, so every derived table grows with them.

The mapping: a supplier is a host, a part is a package, an order is an
advisory range, a line item is an installed component or a finding on a
host, an event user is a reporting host.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The instant every query is evaluated at (2001-11-05).
NOW = 1005000000
#: The same for the events table (2024-01-31).
EVENTS_NOW = 1706659200

_TYPE = """CASE {k} % 10 WHEN 0 THEN 'deb' WHEN 1 THEN 'rpm' WHEN 2 THEN 'apk' WHEN 3 THEN 'npm'
 WHEN 4 THEN 'python' WHEN 5 THEN 'java-archive' WHEN 6 THEN 'go-module' WHEN 7 THEN 'windows'
 WHEN 8 THEN 'deb' ELSE 'binary' END"""

_VERSION = """concat(CASE WHEN {k} % 10 = 6 THEN 'v' ELSE '' END, {a}, '.', {b}, '.', {c},
 CASE WHEN {r} = 0 OR {k} % 10 IN (7, 9) THEN '' WHEN {k} % 10 IN (0, 1, 8) THEN concat('~rc', {r})
  WHEN {k} % 10 = 2 THEN concat('_rc', {r}) WHEN {k} % 10 = 4 THEN concat('rc', {r})
  WHEN {k} % 10 = 5 THEN concat('-rc-', {r}) ELSE concat('-rc.', {r}) END,
 CASE WHEN {k} % 10 IN (0, 1, 8) THEN '-1' WHEN {k} % 10 = 2 THEN '-r0' ELSE '' END)"""

TABLES: dict[str, str] = {
    "t_host": """
        SELECT s_suppkey, concat('host-', s_suppkey) AS hostname,
          CASE s_nationkey % 3 WHEN 0 THEN 'ubuntu' WHEN 1 THEN 'rhel' ELSE 'alpine' END AS os,
          CASE s_nationkey % 3 WHEN 0 THEN '22.04' WHEN 1 THEN '9.3' ELSE '3.19.1' END AS release,
          CAST(1005000000 - (s_suppkey * 37 % 400) * 43200 AS BIGINT) AS host_last_scan,
          concat('machine-', s_suppkey) AS machine_id
        FROM b_supplier""",
    "t_component_parts": """
        SELECT l_suppkey, l_partkey, l_returnflag,
          CAST(max(l_quantity) AS INT) % 3 + 1 AS maj, CAST(max(l_linenumber) AS INT) AS mnr,
          CAST(count(*) % 5 AS INT) AS pat, CAST(sum(l_linenumber) % 3 AS INT) AS rc,
          max(@EPOCH(l_shipdate)) AS scanned_at
        FROM b_lineitem GROUP BY l_suppkey, l_partkey, l_returnflag""",
    "t_component": f"""
        SELECT c.*, h.hostname, h.os AS os_id, h.release AS os_version_id, concat('pkg', l_partkey) AS name,
          {_TYPE.format(k='l_partkey')} AS type,
          {_VERSION.format(k='l_partkey', a='maj', b='mnr', c='pat', r='rc')} AS version,
          CASE l_returnflag WHEN 'A' THEN concat('pkg:generic/pkg', l_partkey, '?upstream=src', l_partkey % 10, '-',
              CAST(floor(l_partkey / 40) AS BIGINT))
            WHEN 'R' THEN concat('pkg:deb/ubuntu/pkg', l_partkey, '?distro=ubuntu-22.04') ELSE '' END AS purl,
          CASE l_returnflag WHEN 'N' THEN concat('/snap/core20/1/lib/pkg', l_partkey)
            ELSE concat('/usr/lib/pkg', l_partkey) END AS path,
          CASE l_returnflag WHEN 'R' THEN concat('container:c', l_suppkey) ELSE '/' END AS root
        FROM t_component_parts c JOIN t_host h ON c.l_suppkey = h.s_suppkey""",
    "t_range_parts": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
          CAST(o_orderkey % 2 AS INT) AS i_maj, CAST(o_orderkey % 4 AS INT) AS i_mnr,
          CAST(o_orderkey % 3 + 1 AS INT) AS f_maj, CAST(o_orderkey % 8 AS INT) AS f_mnr,
          CAST(o_orderkey % 5 AS INT) AS f_pat, CAST(o_orderkey % 4 AS INT) AS kind
        FROM b_orders""",
    "t_range": f"""
        SELECT r.*, {_TYPE.format(k='o_custkey')} AS ecosystem,
          CASE WHEN o_orderkey % 5 = 0 THEN concat('src', o_custkey % 10, '-', CAST(floor(o_custkey / 40) AS BIGINT))
            ELSE concat('pkg', o_custkey) END AS package,
          concat('ADV-', o_orderkey) AS advisory_id,
          concat('CVE-2024-', 10000 + o_custkey * 4 + o_orderkey % 4) AS cve_id,
          CASE WHEN kind IN (1, 2) THEN {_VERSION.format(k='o_custkey', a='i_maj', b='i_mnr', c='0', r='0')}
            ELSE '' END AS introduced,
          CASE WHEN kind = 3 THEN {_VERSION.format(k='o_custkey', a='i_maj', b='i_mnr', c='0', r='0')}
            ELSE '' END AS introduced_excluding,
          CASE WHEN kind IN (0, 1, 3) THEN {_VERSION.format(k='o_custkey', a='f_maj', b='f_mnr', c='f_pat', r='1')}
            ELSE '' END AS fixed,
          CASE WHEN kind = 2 THEN {_VERSION.format(k='o_custkey', a='f_maj', b='f_mnr', c='f_pat', r='1')}
            ELSE '' END AS last_affected,
          CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3') THEN 'ubuntu' ELSE '' END AS distro,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '22.04' WHEN '3' THEN '20.04' ELSE '' END AS distro_release,
          '' AS distro_variant,
          CASE WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'nvd' ELSE 'osv' END AS feed_source,
          'ECOSYSTEM' AS range_type, 'affected' AS status
        FROM t_range_parts r""",
    "t_notaffected": """
        SELECT ecosystem, package, advisory_id, distro, distro_release, distro_variant
        FROM t_range WHERE o_orderstatus = 'P' AND distro <> ''""",
    "t_advisory": """
        SELECT concat('ADV-', o_orderkey) AS advisory_id,
          concat('CVE-2024-', 10000 + o_custkey * 4 + o_orderkey % 4) AS cve_id,
          concat('Flaw in product ', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN ' with a much longer advisory title text' ELSE '' END) AS title,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium'
            WHEN '4' THEN '' ELSE 'low' END AS severity,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 10 END AS cvss_score,
          CASE o_orderkey % 5 WHEN 0 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H'
            WHEN 1 THEN 'CVSS:3.1/AV:N/AC:L/PR:L/UI:R/S:U/C:H/I:L/A:N' WHEN 2 THEN 'CVSS:3.1/AV:L/AC:H/PR:L/UI:N/S:C/C:L/I:N/A:H'
            WHEN 3 THEN 'CVSS:3.1/AV:A/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H' ELSE '' END AS cvss_vector,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 1000 AS DOUBLE) / 1000 END AS epss,
          CASE WHEN o_orderkey % 9 = 0 THEN '2001-05-01' ELSE '' END AS kev_added,
          CASE WHEN o_orderkey % 9 = 0 THEN '2001-06-01' ELSE '' END AS kev_due,
          CASE WHEN o_orderkey % 18 = 0 THEN 'Known' WHEN o_orderkey % 9 = 0 THEN 'Unknown' ELSE '' END AS kev_ransomware,
          concat('CWE-', o_custkey % 60) AS cwe_a, concat('CWE-', o_orderkey % 60) AS cwe_b,
          CAST(o_orderdate AS VARCHAR(10)) AS published
        FROM b_orders""",
    "t_finding_parts": """
        SELECT l_suppkey, l_partkey, CAST(count(*) AS BIGINT) AS n, min(@EPOCH(l_shipdate)) AS first_seen,
          max(@EPOCH(l_shipdate)) AS last_seen, max(l_returnflag) AS flag, max(l_linestatus) AS line,
          CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(max(l_orderkey) AS BIGINT) AS okey
        FROM b_lineitem GROUP BY l_suppkey, l_partkey""",
    "t_finding": f"""
        SELECT concat(l_suppkey, '-', l_partkey) AS finding_key, concat('host-', l_suppkey) AS hostname,
          concat('pkg', l_partkey) AS package, {_TYPE.format(k='l_partkey')} AS ecosystem,
          concat('/usr/lib/pkg', l_partkey) AS path,
          concat('CVE-2024-', 10000 + CAST(floor(l_partkey * 3 / 4) AS BIGINT) * 4 + l_partkey % 4) AS cve_id,
          CASE flag WHEN 'A' THEN '' WHEN 'N' THEN 'snap:core20' ELSE concat('container:c', l_suppkey) END AS scope_id,
          CASE flag WHEN 'A' THEN 'host' WHEN 'N' THEN 'snap' ELSE 'container' END AS scope,
          CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS severity,
          CASE WHEN lines % 3 = 0 THEN 'informational' WHEN lines % 3 = 1 THEN 'high' ELSE 'low' END AS confidence,
          CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST(l_partkey * 7 % 1000 AS DOUBLE) / 1000 END AS epss,
          CASE WHEN l_partkey % 6 = 0 THEN '2001-05-01' ELSE '' END AS kev_added,
          CASE WHEN l_partkey % 6 = 0 THEN '2001-06-01' ELSE '' END AS kev_due,
          CASE WHEN lines % 4 = 0 THEN '' ELSE concat('9.', lines % 4) END AS fixed_version,
          concat('1.', lines % 5) AS last_version, concat('1.', lines % 2) AS first_version,
          concat('Flaw ', l_partkey % 40, CASE WHEN l_suppkey % 2 = 0 THEN ' long form' ELSE '' END) AS title,
          first_seen, last_seen, last_seen + 100 AS last_match_run, first_seen + 100 AS first_found, n AS times_seen,
          CASE WHEN line = 'F' AND n = 1 THEN 'mitigated' WHEN n = 2 AND line = 'F' THEN 'removed' ELSE 'open' END AS status,
          CASE WHEN okey % 13 = 0 THEN '1' ELSE '0' END AS accepted,
          CASE WHEN okey % 13 = 0 THEN concat('exc-', okey % 50) ELSE '' END AS exception_key,
          CASE WHEN line = 'F' AND n <= 2 THEN last_seen + 500 END AS closed_at,
          CASE WHEN okey % 97 = 0 THEN last_seen END AS archived,
          round((1005000000 - first_seen) / CAST(86400 AS DOUBLE), 1) AS age_days
        FROM t_finding_parts""",
    "t_exposure": """
        SELECT concat('host-', l_suppkey) AS hostname, CAST(1 + l_partkey % 30 AS BIGINT) * 100 + l_linenumber AS port,
          CASE WHEN l_linestatus = 'O' THEN 'tcp' ELSE 'udp' END AS protocol,
          concat('10.', l_suppkey % 200, '.', l_linenumber, '.1') AS address,
          CASE max(l_returnflag) WHEN 'A' THEN 'wildcard' WHEN 'N' THEN 'specific' ELSE 'loopback' END AS bind_scope,
          concat('/usr/sbin/daemon', l_partkey % 17) AS executable,
          CASE WHEN l_partkey % 3 = 0 THEN concat('unit', l_partkey % 11) END AS unit,
          CASE WHEN l_partkey % 10 = 9 THEN NULL ELSE concat('pkg', l_partkey) END AS package,
          CASE WHEN l_partkey % 4 = 0 THEN concat('c', l_suppkey, 'abcdefghijklmnop') ELSE '' END AS container_id,
          CASE WHEN l_partkey % 4 = 0 THEN concat('web|', l_suppkey) ELSE '' END AS container_name,
          CASE WHEN l_partkey % 20 = 9 THEN 1 ELSE 0 END AS held_by_os,
          max(@EPOCH(l_shipdate)) AS scanned_at
        FROM b_lineitem GROUP BY l_suppkey, l_partkey, l_linenumber, l_linestatus""",
    "t_attack": """
        SELECT cwe, technique, max(technique_name) AS technique_name, max(tactics) AS tactics, max(platforms) AS platforms,
          max(map_source) AS map_source, max(via_capec) AS via_capec FROM (
          SELECT concat('CWE-', p_partkey % 50) AS cwe, concat('T1', lpad(CAST(p_size % 40 AS VARCHAR(8)), 3, '0')) AS technique,
            concat('Technique ', p_size % 40) AS technique_name,
            CASE p_size % 4 WHEN 0 THEN 'initial-access' WHEN 1 THEN 'execution,persistence' WHEN 2 THEN 'impact' ELSE '' END AS tactics,
            CASE WHEN p_size % 2 = 0 THEN 'Linux' ELSE 'Windows' END AS platforms,
            CASE WHEN p_partkey % 50 < 30 THEN 'capec' ELSE 'cwe_parent' END AS map_source,
            concat(p_size % 20, ',', p_size % 7) AS via_capec
          FROM b_part) x GROUP BY cwe, technique""",
    "t_tactic": """
        SELECT DISTINCT CASE r_regionkey WHEN 0 THEN 'initial-access' WHEN 1 THEN 'execution' WHEN 2 THEN 'persistence'
            WHEN 3 THEN 'impact' ELSE 'other' END AS tactic, concat('Tactic ', r_regionkey) AS tactic_name,
          CAST(r_regionkey AS INT) AS tactic_order FROM b_region""",
    "t_flow": """
        SELECT concat(CASE WHEN o_custkey % 3 = 0 THEN '203.0.' ELSE '10.' END,
            CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 4 ELSE o_custkey % 200 END, '.',
            CASE WHEN o_custkey % 3 = 0 THEN concat(o_custkey % 250) ELSE concat(1 + o_custkey % 7, '.1') END) AS src_ip,
          concat('10.', l_suppkey % 200, '.', l_linenumber, '.1') AS dest_ip,
          CAST(1 + l_partkey % 30 AS BIGINT) * 100 + l_linenumber AS port,
          CASE WHEN l_linestatus = 'O' THEN 'TCP' END AS protocol,
          CASE WHEN l_returnflag = 'R' THEN 'denied' ELSE 'allowed' END AS action,
          @EPOCH(l_shipdate) AS ts
        FROM b_lineitem JOIN b_orders ON l_orderkey = o_orderkey""",
    "t_edge": """
        SELECT src_ip, dest_ip, port, lower(coalesce(protocol, 'tcp')) AS protocol, CAST(count(*) AS BIGINT) AS sessions,
          min(ts) AS edge_first_seen, max(ts) AS edge_last_seen
        FROM t_flow WHERE action = 'allowed' GROUP BY src_ip, dest_ip, port, lower(coalesce(protocol, 'tcp'))""",
    "t_entry": """
        SELECT concat('203.0.', n_nationkey % 4, '.', (n_nationkey % 3) * 64, '/', 24 + 2 * (n_nationkey % 2)) AS cidr,
          concat('net ', n_nationkey) AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'constant' ELSE 'occasional' END AS pressure
        FROM b_nation""",
    "t_claim": """
        SELECT concat('host-', l_suppkey) AS hostname, concat('10.', l_suppkey % 200, '.', l_linenumber, '.1') AS address,
          'ipv4' AS family, min(@EPOCH(l_shipdate)) AS addr_first_seen, max(@EPOCH(l_shipdate)) AS addr_last_seen,
          CAST(count(*) AS BIGINT) AS observations, CAST(86400 * (l_suppkey % 12) AS BIGINT) AS max_gap
        FROM b_lineitem GROUP BY l_suppkey, l_linenumber""",
    "t_heartbeat": """
        SELECT event_id, concat('host-', user_id) AS hostname, @EPOCH(ts) AS scanned_at, event_type, value, props,
          user_id FROM b_events""",
    "t_verdict": """
        SELECT concat('CVE-2024-', 10000 + o_custkey * 4 + o_orderkey % 4) AS cve_id,
          CAST(max(o_orderkey) % 101 AS INT) AS priority_score,
          concat('P', CAST(max(o_orderkey) % 5 AS INT)) AS priority_tier,
          CAST(1005000000 - (max(o_orderkey) % 12) * 86400 AS BIGINT) AS analysed_at,
          CAST(max(o_orderkey) % 10 AS DOUBLE) / 10 AS confidence, 'monitor' AS recommended_action,
          concat('Rationale ', max(o_orderkey)) AS rationale, 'T2' AS analysis_source, md5(concat(max(o_orderkey))) AS sig
        FROM b_orders GROUP BY o_custkey, o_orderkey % 4""",
    "t_exception": """
        SELECT concat('exc-', o_orderkey) AS exception_key,
          CASE o_orderkey % 3 WHEN 0 THEN 'finding' WHEN 1 THEN 'host_cve' ELSE 'fleet_cve' END AS scope_kind,
          concat('CVE-2024-', 10000 + CAST(floor(o_custkey * 3 / 4) AS BIGINT) * 4 + o_custkey % 4) AS cve_id,
          CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE concat('host-', o_orderkey % 100) END AS hostname,
          CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderkey % 100, '-', o_custkey) ELSE '' END AS finding_key,
          @EPOCH(o_orderdate) AS created_at,
          CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(@EPOCH(o_orderdate) + 126230400) END AS expires_at,
          CASE WHEN o_orderstatus = 'P' THEN concat(@EPOCH(o_orderdate) + 86400) ELSE '' END AS revoked_at,
          CASE o_orderkey % 3 WHEN 0 THEN concat('find|', o_orderkey % 100, '-', o_custkey)
            WHEN 1 THEN concat('host|host-', o_orderkey % 100, '|CVE-2024-', 10000 + CAST(floor(o_custkey * 3 / 4) AS BIGINT) * 4 + o_custkey % 4)
            ELSE concat('fleet|CVE-2024-', 10000 + CAST(floor(o_custkey * 3 / 4) AS BIGINT) * 4 + o_custkey % 4) END AS match_key,
          o_clerk_text AS control
        FROM (SELECT o.*, concat('control ', o_custkey) AS o_clerk_text FROM b_orders o) z""",
    "t_netevidence": """
        SELECT concat('host-', l_suppkey) AS hostname, CAST(1 + l_partkey % 30 AS BIGINT) * 100 + l_linenumber AS port,
          CASE max(l_orderkey) % 4 WHEN 0 THEN 'confirmed observed' WHEN 1 THEN 'historically observed'
            WHEN 2 THEN 'not observed' ELSE 'unknown' END AS observed_grade,
          CASE max(l_orderkey) % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'host not in graph' ELSE 'firewall data stale' END AS coverage_state,
          CASE max(l_orderkey) % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'shared' WHEN 2 THEN 'stale' WHEN 3 THEN 'outside estate'
            ELSE 'no edge to resolve' END AS identity_state,
          CASE WHEN max(l_orderkey) % 2 = 0 THEN concat('203.0.', l_suppkey % 4, '.0/24') END AS entry_text,
          CASE WHEN l_linenumber % 2 = 0 THEN 'udp tcp' ELSE 'tcp' END AS protocols_text,
          CAST(sum(l_quantity) AS BIGINT) AS sessions, max(@EPOCH(l_shipdate)) AS edge_last_seen,
          CASE WHEN max(l_orderkey) % 7 = 0 THEN '' ELSE 'unknown' END AS previous_grade,
          CAST(1005000000 - (max(l_orderkey) % 40) * 400 AS BIGINT) AS grade_changed_at,
          CASE WHEN max(l_orderkey) % 6 = 0 THEN CAST(1005000000 - (max(l_orderkey) % 50) * 300 AS BIGINT) END AS reappeared_at
        FROM b_lineitem GROUP BY l_suppkey, 1 + l_partkey % 30, l_linenumber""",
    "t_jump": """
        SELECT CASE WHEN o_custkey % 25 = 0 THEN concat('entry-', CAST(o_custkey / 25 AS BIGINT) % 4) ELSE concat('host-', o_custkey) END AS src,
          concat('host-', l_suppkey * 3) AS dst, CASE WHEN o_custkey % 25 = 0 THEN 'entry' ELSE 'host' END AS kind,
          concat(100 + l_linenumber) AS port, 'tcp' AS protocol, CAST(l_quantity AS DOUBLE) AS sessions,
          CAST(@EPOCH(l_shipdate) AS DOUBLE) AS edge_last_seen, CAST(l_partkey % 4 AS INT) AS rk_rank,
          CASE WHEN l_partkey % 4 = 3 THEN concat('CVE-', l_partkey) ELSE '' END AS wire_text,
          CASE WHEN l_partkey % 4 = 2 THEN concat('CVE-', l_partkey) ELSE '' END AS foot_text
        FROM b_lineitem JOIN b_orders ON l_orderkey = o_orderkey""",
}

_TOKEN = re.compile(r"\b([bt]_[a-z_]+)\b")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(n for n in _TOKEN.findall(sql) if n in TABLES or n.startswith("b_")))


def _epoch(sql: str, template: str) -> str:
    return re.sub(r"@EPOCH\(([^()]+)\)", lambda m: template.format(m.group(1)), sql)


class Bed:
    """Spark side: the derived tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def sql(self, text: str) -> DataFrame:
        tag = f"vs{abs(hash(self.folder)) % 10**8}_"
        for name in _names(text):
            self[name].createOrReplaceTempView(tag + name)
        text = _TOKEN.sub(lambda m: tag + m.group(1) if m.group(1) in _names(text) else m.group(1), text)
        text = _epoch(text, "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {}) AS BIGINT)")
        return self.spark.sql(text)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name.startswith("b_"):
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name[2:]}.parquet")
            else:
                self._frames[name] = self.sql(TABLES[name])
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        """``bed.finding`` is the derived table, ``bed.b_part`` the given one."""
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name if name.startswith("b_") else f"t_{name}"]


def _chain(sql: str, seen: dict[str, str]) -> None:
    for name in _names(sql):
        if name.startswith("t_") and name not in seen:
            _chain(TABLES[name], seen)
            seen[name] = TABLES[name]


def oracle_text(sql: str) -> str:
    """DuckDB side: the query with the derived tables it uses in front."""
    seen: dict[str, str] = {}
    _chain(sql, seen)
    head = ", ".join(f"{n} AS ({t})" for n, t in seen.items())
    body = sql.strip()
    if head and body[:5].upper() == "WITH ":
        body = f"WITH {head}, {body[5:]}"
    elif head:
        body = f"WITH {head} {body}"
    body = re.sub(r"\bb_([a-z]+)\b", r"\1", body)
    return _epoch(body, "CAST(floor(epoch({})) AS BIGINT)")
