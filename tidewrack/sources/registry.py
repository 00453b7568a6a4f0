"""The registry of sources: rows with endpoints that a run's window fills in."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKBACK_DAYS = 14
SCHEMA = "id string, name string, publisher_group string, kind string, authority double, lane_hints map<string,double>, endpoint string, expects string, enabled boolean, max_items int, zone string, exclude array<string>, paywalled boolean"


@dataclass
class Source:
    id: str
    name: str
    endpoint: str
    publisher_group: str
    kind: str = "news"
    authority: float = 0.5
    lane_hints: dict[str, float] = field(default_factory=dict)
    expects: str = "xml"
    enabled: bool = True
    max_items: int = 50
    zone: str = "UTC"
    exclude: list[str] = field(default_factory=list)
    paywalled: bool = False


def load(spark: SparkSession, sources: list[Source]) -> DataFrame:
    names = [c.split(" ", 1)[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(asdict(s)[n] for n in names) for s in sources], SCHEMA)


def enabled(sources: DataFrame, only: list[str] | None = None) -> DataFrame:
    found = sources.filter("enabled")
    return found.filter(F.col("id").isin(only)) if only else found


def by_id(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.filter(F.col("id") == source_id).limit(1)


def endpoint(sources: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``url``: the endpoint with {start}, {end} and {lookback} as dates of the run's window."""
    url = F.col("endpoint")
    for name, at in (("start", start), ("end", end), ("lookback", end - timedelta(days=LOOKBACK_DAYS))):
        url = F.replace(url, F.lit("{" + name + "}"), F.lit(at.strftime("%Y-%m-%d")))
    return sources.withColumn("url", url)


#: Fields that a trial search asks for, below protocolSection.
TRIAL_FIELDS = (
    "identificationModule.nctId identificationModule.briefTitle descriptionModule.briefSummary designModule.phases designModule.enrollmentInfo.count sponsorCollaboratorsModule.leadSponsor.name"
    " conditionsModule.conditions armsInterventionsModule.interventions statusModule.lastUpdatePostDateStruct.date statusModule.startDateStruct.date"
).split()


def trial_endpoint(base: str, size: int = 40) -> str:
    """A trial search with filters and projection pushed into the request: recruiting phase 3 trials of industry, updated since {start}."""
    from urllib.parse import quote

    term = quote("AREA[LastUpdatePostDate]RANGE[", safe="") + "{start}" + quote(",MAX] AND AREA[Phase]PHASE3 AND AREA[LeadSponsorClass]INDUSTRY", safe="")
    fields = ",".join(f"protocolSection.{f}" for f in TRIAL_FIELDS)
    return f"{base}?pageSize={size}&countTotal=false&filter.overallStatus=NOT_YET_RECRUITING|RECRUITING&query.term={term}&fields={fields}"


def literature_endpoint(base: str, journals: list[str], size: int = 100) -> str:
    """A literature search with its predicates pushed into the request: journals, abstracts only, dates, order, size."""
    names = " OR ".join(f'JOURNAL:"{j}"' for j in journals)
    return f"{base}?query=({names}) AND HAS_ABSTRACT:Y AND FIRST_PDATE:[{{lookback}} TO {{end}}]&sort=P_PDATE_D desc&pageSize={size}&format=json&resultType=core"
