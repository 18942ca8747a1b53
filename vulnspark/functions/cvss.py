"""CVSS vectors and score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import blank, extract

# Wording of each CVSS letter.
_WORDS = {
    "reach": (("AV:N", "over a network"), ("AV:A", "from an adjacent network"),
              ("AV:L", "with local access to the machine"), ("AV:P", "with physical access")),
    "complexity": (("AC:L", "no special conditions"), ("AC:H", "conditions the attacker cannot control")),
    "privileges": (("PR:N", "none, no account needed"), ("PR:L", "an ordinary account"),
                   ("PR:H", "an administrative account")),
    "user_interaction": (("UI:N", "none, nobody has to be tricked"),
                         ("UI:R", "somebody must open or click something")),
    "confidentiality": (("C:H", "total disclosure"), ("C:L", "some disclosure"), ("C:N", "none")),
    "integrity": (("I:H", "anything can be modified"), ("I:L", "some modification"), ("I:N", "none")),
    "availability": (("A:H", "service can be taken down"), ("A:L", "degraded service"), ("A:N", "none")),
}


def cvss_english(df: DataFrame, vector: str = "cvss_vector") -> DataFrame:
    """Each part of a vector in words."""
    v = blank(vector)
    out = {"vector": F.when(v == "", "none published").otherwise(v)}
    for name, choices in _WORDS.items():
        expr = F
        for letters, words in choices:
            expr = expr.when(v.contains(letters), words)
        out[name] = expr.otherwise("not stated")
    return df.withColumns(out)


def preferred_vector(vectors: Column) -> Column:
    """The first CVSS v3 vector of several, else the first vector."""
    v3 = F.filter(vectors, lambda v: v.startswith("CVSS:3"))
    return F.coalesce(F.get(v3, F.lit(0)), F.get(vectors, F.lit(0)))


def cvss_letters(vector: Column) -> dict[str, Column]:
    """The v3 letters, null where the vector does not carry one."""
    return {
        "av": extract(vector, "AV:([NALP])"),
        "pr": extract(vector, "PR:([NLH])"),
        "ui": extract(vector, "UI:([NR])"),
        "s": extract(vector, "S:([UC])"),
        "c": extract(vector, "/C:([NLH])"),
        "i": extract(vector, "/I:([NLH])"),
        "a": extract(vector, "/A:([NLH])"),
    }


def network_rank(vector: Column) -> Column:
    """How usable one vector is over a network: 3 as is, 2 with a foothold, 0 not."""
    return (F.when(~vector.rlike("AV:[NA]"), 0)
            .when(~vector.rlike("/(C|I|VC|VI|SC|SI):[HC]"), 0)
            .when(vector.contains("PR:N") & vector.contains("UI:N"), 3)
            .otherwise(2))


def cvss_reach(vectors: Column) -> Column:
    """struct(rank, down) over every vector of a CVE.

    Rank 1 means no vector says. ``down`` is 1 for reachable but crash-only,
    2 for reachable with only a minor leak or change.
    """
    usable = F.filter(vectors, lambda v: v.contains("AV:"))
    rank = F.coalesce(F.array_max(F.transform(usable, network_rank)), F.lit(1))
    reachable = F.coalesce(F.exists(usable, lambda v: v.rlike("AV:[NA]")), F.lit(False))
    minor = F.exists(usable, lambda v: v.rlike("AV:[NA].*/(C|I|VC|VI|SC|SI):[LP]"))
    down = F.when((rank != 0) | ~reachable, 0).when(minor, 2).otherwise(1)
    return F.struct(rank.alias("rank"), down.alias("down"))


def epss_band(epss: Column) -> Column:
    e = F.coalesce(epss, F.lit(0.0))
    return (F.when(e < 0.01, "0").when(e < 0.05, "1").when(e < 0.2, "2")
            .when(e < 0.5, "3").otherwise("4"))


def cvss_band(score: Column) -> Column:
    """Empty when there is no score."""
    return (F.when(score.isNull(), "").when(score < 4, "0").when(score < 7, "1")
            .when(score < 9, "2").otherwise("3"))
