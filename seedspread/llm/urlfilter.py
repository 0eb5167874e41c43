"""URL filters whose list entries hold for a time: an as-of join of captures and lists.

Entries ``(list, pattern, action, at)`` add a pattern to a list or remove it from one at a
time.  Ordered by time they become validity intervals: an ``add`` holds from its time to
the pattern's next entry.  A pattern is a domain (``example.org``: the host and its
subdomains) or a host with a path (``example.org/a``: the path and what lies below).

A URL has few keys that an entry could have: its host and the domains above it, of up to
as many labels as the longest pattern has, and its host with each prefix of its path, up
to as many segments as the longest pattern has.
Keys and intervals are joined on the key, with the capture's time within the interval,
so each capture meets, of each pattern, the one entry that is active when it was fetched.

Everything is built-in functions.  URLs are evaluated once for each (URL, time); the rows
of a host that holds a third of all captures are split by AQE in the join (the intervals
of its keys are few).  Only URLs and times are shuffled, no page content.

Defined cases: a null URL or time, an empty URL and one without a host match nothing and
pass; entries without a list, pattern, action or time are no entries; of entries for one
pattern and time a ``remove`` wins; repeated captures are each returned; host and pattern
are compared without upper case, paths with it; the default port, user and fragment don't
count.  ``keep`` names the columns returned beside ``lists``, ``n_matches``, ``blocked``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seedspread.llm.common import broadcast_if_small, col, written
from seedspread.llm.quality import bind


def host(url: Column) -> Column:
    """The host of a URL in lower case (empty if there is none)."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit("."))


def path(url: Column) -> Column:
    """The path of a URL without slashes at its ends."""
    return F.trim(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?[^/?#]*([^?#]*)", 1), F.lit("/"))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, key, valid_from, valid_to)`` of the spells in which a pattern is on a list; an open end is null."""
    whole = entries.where("list is not null and pattern is not null and action in ('add', 'remove') and at is not null")
    cut = F.trim(F.regexp_replace("pattern", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", ""), F.lit("/"))
    key = F.concat(F.rtrim(F.lower(F.substring_index(cut, "/", 1)), F.lit(".")), F.regexp_extract(cut, r"(/.*)?$", 0))
    key = F.when(F.instr(cut, "/") > 0, key).otherwise(F.rtrim(F.lower(cut), F.lit(".")))
    steps = whole.groupBy("list", key.alias("key"), "at").agg(F.max("action").alias("action"))  # "remove" is the greater word
    following = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    return steps.withColumn("valid_to", following).where("action = 'add' and key <> ''").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def keys(url: Column, depth: int, width: int) -> Column:
    """The keys of a URL: its host, the domains above it (of two labels or more), and its host with each path prefix of up to ``depth`` segments.

    Hosts and domains of more than ``width`` labels (two at least) are left out: no pattern
    has so many.
    """
    labels = F.split(host(url), r"\.")
    first = lambda ls: F.greatest(F.lit(1), F.size(ls) - (max(2, width) - 1))
    up = lambda ls: F.transform(F.sequence(first(ls), F.greatest(F.lit(1), F.size(ls) - 1)), lambda i: F.array_join(F.slice(ls, i, F.size(ls)), "."))
    domains = F.when(host(url).rlike(r"^[0-9.]*$"), F.array(host(url))).otherwise(bind(labels, up))
    below = lambda s: F.when(s[0] != "", F.transform(F.sequence(F.lit(1), F.least(F.size(s), F.lit(depth))), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(s, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(domains, bind(F.split(path(url), "/"), below)) if depth else domains, lambda k: (k != "") & ~k.startswith("/"))


def verdicts(captures: DataFrame, spells: DataFrame, allow: Sequence[str] = (), url_col: str = "url", time_col: str = "fetched", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default), the names of the ``lists`` that the capture is on, its matches, and whether it is ``blocked``.

    A capture is blocked if it is on a list, unless it is on one of the lists ``allow`` too.
    """
    added = ("lists", "n_matches", "blocked")
    keep = [c for c in (captures.columns if keep is None else keep) if c.lower() not in added]
    spells = written(spells, "spells")
    signs = lambda text, sign: F.max(F.length(text) - F.length(F.translate(text, sign, "")))
    depth, dots = (n or 0 for n in spells.agg(signs(F.col("key"), "/"), signs(F.substring_index("key", "/", 1), ".")).first())
    asked = captures.where(col(url_col).isNotNull() & col(time_col).isNotNull()).select(col(url_col).alias("_url"), col(time_col).alias("_time")).distinct()
    keyed = asked.select("_url", "_time", F.explode(F.array_distinct(keys(F.col("_url"), depth, dots + 1))).alias("_key"))
    active = (F.col("_key") == F.col("key")) & (F.col("_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to")))
    hits = keyed.join(broadcast_if_small(spells), active)
    found = hits.groupBy("_url", "_time").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.count("*").alias("n_matches"))
    same = (col(url_col) == F.col("_url")) & (col(time_col) == F.col("_time"))
    rows = captures.select(*[col(c) for c in dict.fromkeys([*keep, url_col, time_col])]).join(found, same, "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    blocked = (F.size(lists) > 0) & ~F.arrays_overlap(lists, F.array(*map(F.lit, allow)).cast("array<string>"))
    return rows.select(*[col(c) for c in keep], lists.alias("lists"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), blocked.alias("blocked"))


def passing(captures: DataFrame, spells: DataFrame, allow: Sequence[str] = (), url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """The captures that no list blocks when they were fetched, with the columns of ``captures``."""
    packed = captures.select(F.struct(*[col(c) for c in captures.columns]).alias("_row"), col(url_col).alias("_u"), col(time_col).alias("_t"))
    judged = verdicts(packed, spells, allow, "_u", "_t").where("not blocked")
    return judged.select(*[F.col("_row")[c].alias(c) for c in captures.columns])
