"""From landed bodies to items: feeds (RSS 2, RDF, Atom), literature and trials JSON. A body that can't be read is a warning
of its source, never the end of a run."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.extract.facts import nct_ids
from tidewrack.functions.dates import parse_feed_date
from tidewrack.functions.markup import clean_title_markup, html_to_text, strip_journal_boilerplate, wrong_shape
from tidewrack.functions.text import squish
from tidewrack.functions.urls import canonical_url, extract_doi, item_id
from tidewrack.session import lookup

FIELDS = ("title", "link", "guid", "published", "dc_date", "prism_date", "creator", "content", "description", "doi")
RAW = "source_id string, pos int, " + ", ".join(f"{f} string" for f in FIELDS) + ", categories array<string>, warning string"
#: Local names of elements, and the field each fills.
ELEMENTS = {
    "title": "title", "guid": "guid", "id": "guid", "pubDate": "published", "published": "published", "updated": "published", "date": "dc_date", "publicationDate": "prism_date",
    "creator": "creator", "author": "creator", "encoded": "content", "content": "content", "description": "description", "summary": "description", "doi": "doi",
}
#: What an item takes over from its source.
CARRIED = ("source_name", "publisher_group", "source_kind", "authority", "lane_hints")
ITEM_FIELDS = "source_id pos title url canonical_url item_id guid published_at date_precision date_confident body body_provenance categories authors doi nct_ids paywalled".split()


def entries(body: str) -> list[dict]:
    """The entries of a feed in order; raises ParseError."""
    out = []
    for node in ET.fromstring(body.lstrip("﻿ \n\t").encode()).iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        row: dict = {"categories": []}
        for child in node:
            name = child.tag.rpartition("}")[2]
            text = "".join(child.itertext()).strip()
            if name == "link":
                row.setdefault("link", child.get("href") or text)
            elif name == "category":
                row["categories"].append(child.get("term") or text)
            elif (field := ELEMENTS.get(name)) and text:
                row.setdefault(field, text)
        out.append(row)
    return out


def parse_feeds(landed: DataFrame, max_items: DataFrame | None = None) -> DataFrame:
    """One row an entry, or one with a warning for a body that isn't a feed. ``landed``: source_id, body, max_items; the limit
    is on the entries as they stand, before any filter."""

    def apply(batches):
        names = ["source_id", "pos", *FIELDS, "categories", "warning"]
        for batch in batches:
            rows = []
            for source, body, most in zip(*(batch.column(c).to_pylist() for c in ("source_id", "body", "max_items")), strict=True):
                try:
                    found = entries(body or "")
                except ET.ParseError as error:
                    rows.append((source, None, *[None] * len(FIELDS), None, f"not a feed: {error}"))
                    continue
                rows += [(source, i, *(e.get(f) for f in FIELDS), e["categories"], None) for i, e in enumerate(found[:most])]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = [pa.string(), pa.int32(), *[pa.string()] * len(FIELDS), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return landed.select("source_id", "body", "max_items").mapInArrow(apply, RAW)


def carried(items: DataFrame, sources: DataFrame) -> DataFrame:
    """``items`` with what they take over from their source in the registry."""
    names = {"source_name": "name", "source_kind": "kind"}
    return items.join(lookup(sources.select(F.col("id").alias("source_id"), *[F.col(names.get(c, c)).alias(c) for c in CARRIED])), "source_id")


def feed_items(raw: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Entries as items: titles without markup and paywall mark, canonical URLs, the first date that can be read, the best
    body and where it comes from. Excluded URLs and titles go. ``sources`` is the registry, whose authority, name and lane hints items carry on."""
    s = sources.select(F.col("id").alias("source_id"), "kind", "zone", "exclude", F.col("paywalled").alias("walled"))
    d = raw.filter("warning IS NULL").join(lookup(s), "source_id")
    marked = F.coalesce(F.col("title"), F.lit("")).rlike(r"(?i)^\s*STAT\+:")
    title = squish(clean_title_markup(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?i)^\s*STAT\+:\s*", "")))
    d = d.withColumns({f"{c}_": parse_feed_date(F.col(c), F.col("zone"), now) for c in ("published", "dc_date", "prism_date")})
    dates = [F.col("published_"), F.col("dc_date_"), F.col("prism_date_")]
    dated = F.coalesce(*[F.when(x["date"].isNotNull(), x) for x in dates], dates[0])
    full, short = html_to_text(F.coalesce("content", F.lit(""))), html_to_text(F.coalesce("description", F.lit("")))
    d = d.withColumns({"t_": title, "d_": dated, "full_": full, "short_": short, "paywalled": F.col("walled") | marked})
    academic = F.col("kind").isin("journal", "preprint")
    strip = lambda c: F.when(academic, strip_journal_boilerplate(c)).otherwise(c)
    d = d.withColumns({"full_": strip(F.col("full_")), "short_": strip(F.col("short_"))})
    body = F.when(F.length("full_") > 40, F.struct(F.col("full_").alias("text"), F.lit("full").alias("provenance"))).when(
        F.length("short_") > 0, F.struct(F.col("short_").alias("text"), F.when(F.length("short_") >= 400, "description").otherwise("dek").alias("provenance"))
    )
    d = d.withColumn("b_", F.coalesce(body, F.struct(F.lit("").alias("text"), F.lit("none").alias("provenance"))))
    url = canonical_url(F.col("link"))
    out = d.select(
        "source_id", "pos", F.col("t_").alias("title"), F.col("link").alias("url"), url.alias("canonical_url"), item_id(url).alias("item_id"), F.coalesce("guid", "link").alias("guid"),
        F.col("d_.date").alias("published_at"), F.col("d_.precision").alias("date_precision"), F.col("d_.confident").alias("date_confident"), F.col("b_.text").alias("body"),
        F.col("b_.provenance").alias("body_provenance"), "categories", F.when(F.col("creator").isNotNull(), F.array("creator")).otherwise(F.array()).cast("array<string>").alias("authors"),
        F.coalesce("doi", extract_doi(F.col("link"))).alias("doi"), nct_ids(F.concat_ws(" ", "t_", "b_.text")).alias("nct_ids"), "paywalled", "exclude",
    )
    unwanted = F.exists(F.coalesce("exclude", F.array().cast("array<string>")), lambda p: F.regexp_like(F.concat_ws(" ", "url", "title"), p))
    return carried(out.filter(~unwanted).select(*ITEM_FIELDS), sources)


LITERATURE = "resultList struct<result:array<struct<id:string,source:string,doi:string,title:string,authorString:string,abstractText:string,firstPublicationDate:string,journalInfo:struct<journal:struct<title:string>>,fullTextUrlList:struct<fullTextUrl:array<struct<url:string>>>>>>"
TRIALS = (
    "studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,descriptionModule:struct<briefSummary:string>,"
    "designModule:struct<phases:array<string>,enrollmentInfo:struct<count:int>>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,conditionsModule:struct<conditions:array<string>>,"
    "armsInterventionsModule:struct<interventions:array<struct<name:string,type:string>>>,statusModule:struct<lastUpdatePostDateStruct:struct<date:string>,startDateStruct:struct<date:string>>>>>"
)


def literature_items(landed: DataFrame, now: Column) -> DataFrame:
    """Results of a literature search, at most max_items a body: the URL is the DOI's, else the full text's, else the record's."""
    d = landed.withColumn("j", F.from_json("body", LITERATURE, {"mode": "PERMISSIVE"}))
    d = d.select("source_id", "max_items", F.posexplode("j.resultList.result").alias("pos", "r")).filter("pos < max_items")
    doi = F.lower(F.col("r.doi"))
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.get("r.fullTextUrlList.fullTextUrl", F.lit(0))["url"], F.concat(F.lit("https://europepmc.org/article/"), "r.source", F.lit("/"), "r.id"))
    date = parse_feed_date(F.col("r.firstPublicationDate"), None, now)
    body = html_to_text(F.coalesce("r.abstractText", F.lit("")))
    d = d.withColumns({"u_": url, "d_": date, "b_": body})
    c = canonical_url(F.col("u_"))
    return d.select(
        "source_id", "pos", squish(clean_title_markup(F.coalesce("r.title", F.lit("")))).alias("title"), F.col("u_").alias("url"), c.alias("canonical_url"), item_id(c).alias("item_id"),
        F.col("r.id").alias("guid"), F.col("d_.date").alias("published_at"), F.col("d_.precision").alias("date_precision"), F.col("d_.confident").alias("date_confident"), F.col("b_").alias("body"),
        F.when(F.col("b_") != "", "abstract").otherwise("none").alias("body_provenance"), F.array_compact(F.array("r.journalInfo.journal.title")).alias("categories"),
        F.split(F.coalesce("r.authorString", F.lit("")), r",\s*").alias("authors"), doi.alias("doi"), nct_ids(F.col("b_")).alias("nct_ids"), F.lit(False).alias("paywalled"),
    )


def trial_items(landed: DataFrame, now: Column) -> DataFrame:
    """Registered trials: the body is put together from summary, phases, conditions, interventions, sponsor and enrollment."""
    d = landed.withColumn("j", F.from_json("body", TRIALS, {"mode": "PERMISSIVE"}))
    d = d.select("source_id", "max_items", F.posexplode("j.studies.protocolSection").alias("pos", "s")).filter("pos < max_items")
    m = lambda path: F.col("s." + path)
    part = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), c, F.lit(".")))
    joined = lambda c: F.array_join(F.transform(c, squish), ", ")
    phases = F.array_join(F.transform(m("designModule.phases"), lambda p: F.replace(F.lower(p), F.lit("phase"), F.lit("Phase "))), "/")
    body = F.concat_ws(
        " ", squish(m("descriptionModule.briefSummary")), part("Phase", phases), part("Conditions", joined(m("conditionsModule.conditions"))),
        part("Interventions", joined(F.transform(m("armsInterventionsModule.interventions"), lambda i: i["name"]))), part("Sponsor", squish(m("sponsorCollaboratorsModule.leadSponsor.name"))),
        part("Enrollment", m("designModule.enrollmentInfo.count").cast("string")),
    )
    nct = m("identificationModule.nctId")
    url = F.concat(F.lit("https://clinicaltrials.gov/study/"), nct)
    date = parse_feed_date(F.coalesce(m("statusModule.lastUpdatePostDateStruct.date"), m("statusModule.startDateStruct.date")), None, now)
    d = d.withColumns({"u_": url, "d_": date})
    return d.select(
        "source_id", "pos", squish(m("identificationModule.briefTitle")).alias("title"), F.col("u_").alias("url"), canonical_url(F.col("u_")).alias("canonical_url"), item_id(canonical_url(F.col("u_"))).alias("item_id"),
        nct.alias("guid"), F.col("d_.date").alias("published_at"), F.col("d_.precision").alias("date_precision"), F.col("d_.confident").alias("date_confident"), body.alias("body"),
        F.lit("api").alias("body_provenance"), m("conditionsModule.conditions").alias("categories"), F.array_compact(F.array(m("sponsorCollaboratorsModule.leadSponsor.name"))).alias("authors"),
        F.lit(None).cast("string").alias("doi"), F.array(nct).alias("nct_ids"), F.lit(False).alias("paywalled"),
    )


def shape_reasons(landed: DataFrame) -> DataFrame:
    """source_id, reason: bodies that aren't what their source should send. ``landed``: source_id, body, expects."""
    return landed.select("source_id", wrong_shape(F.col("body"), F.col("expects")).alias("reason")).filter("reason IS NOT NULL")


def json_items(landed: DataFrame, now: Column, literature: str = "europepmc", trials: str = "clinicaltrials") -> tuple[DataFrame, DataFrame]:
    """Items of JSON bodies by what their source speaks, told from its id; and source_id, warning of those that no reader knows."""
    is_literature, is_trials = F.col("source_id").startswith(literature), F.col("source_id") == trials
    items = literature_items(landed.filter(is_literature), now).unionByName(trial_items(landed.filter(is_trials), now))
    rest = landed.filter(~is_literature & ~is_trials).select("source_id", F.concat(F.lit("no json reader for "), "source_id").alias("warning"))
    return items, rest
