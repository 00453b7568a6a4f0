"""Canonical URLs, hosts, DOIs and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.text import SPACE

# Tracking parameters, host aliases, hosts always over https.
TRACKING = (
    r"(?i)^(utm_\w+|mc_\w+|mkt_\w+|_hs\w*|hsa_\w+|ref|ref_src|referrer|fbclid|gclid|gbraid|wbraid|igshid|mibextid|cmpid|campaign|source|spm|rss"
    r"|feed|at_\w+|ito|smid|partner)$"
)
HOST_ALIASES = {"endpts.com": "endpoints.news", "www.endpts.com": "endpoints.news", "www.endpoints.news": "endpoints.news"}
HTTPS_HOSTS = ("www.fda.gov", "fda.gov")


def canonical_url(raw: Column) -> Column:
    """Lower-case host with aliases, no fragment, user, default port, tracking parameter or closing slash; parameters by name.
    What isn't a URL stays as it is, without white space."""
    url = F.regexp_replace(raw, SPACE + "+", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(rest, r"^.*@", ""))
    host = F.regexp_replace(host, r":(80|443)$", "")
    for name, alias in HOST_ALIASES.items():
        host = F.when(host == name, alias).otherwise(host)
    path = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*(/[^?#]*)?", 1)
    path = F.when(path == "", "/").otherwise(path)
    path = F.when(path.rlike("^/+$"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)),
        lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")),
    )
    kept = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["p"]), "&")
    scheme = F.when((scheme == "http") & host.isin(*HTTPS_HOSTS), "https").otherwise(scheme)
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), whole).otherwise(url)


def host_of(raw: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), r":\d+$", ""))


def extract_doi(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?<![A-Za-z0-9_])(10\.\d{4,9}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9])(?![A-Za-z0-9_])", 1)
    return F.when(found != "", F.regexp_replace(F.lower(found), r"[.,;)]+$", ""))


def short_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def item_id(url: Column) -> Column:
    return short_hash(url, 16)


def cluster_id(ids: Column) -> Column:
    return F.concat(F.lit("c_"), short_hash(F.array_join(F.array_sort(ids), "|"), 10))
