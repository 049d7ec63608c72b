"""Study inputs derived from the star-schema test tables.

A cohort study needs person, visit, fact, comorbidity and death tables. Here a customer plays a
person, an order a visit, a nation group a site, the quarter of a finished order its macro-visit,
and the first order of a given priority an index event. Everything is a Spark plan over the given
tables; nothing is generated.

Orders and lines are reduced to one row per person and day before any other join, so a person
holding a large share of all rows shrinks to at most one row per calendar day.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import indicator
from ..runtime import checkpointed
from .tables import read_table

# Names of the condition indicators in the feature tables.
CONDITIONS = (
    "TUBERCULOSIS", "MILDLIVERDISEASE", "MODERATESEVERELIVERDISEASE", "THALASSEMIA",
    "RHEUMATOLOGICDISEASE", "DEMENTIA", "CONGESTIVEHEARTFAILURE", "SUBSTANCEUSEDISORDER",
    "DOWNSYNDROME", "KIDNEYDISEASE", "MALIGNANTCANCER", "DIABETESCOMPLICATED",
    "CEREBROVASCULARDISEASE", "PERIPHERALVASCULARDISEASE", "PREGNANCY", "HEARTFAILURE",
    "HEMIPLEGIAORPARAPLEGIA", "PSYCHOSIS", "CORONARYARTERYDISEASE", "SYSTEMICCORTICOSTEROIDS",
    "DEPRESSION", "METASTATICSOLIDTUMORCANCERS", "HIVINFECTION", "CHRONICLUNGDISEASE",
    "PEPTICULCER", "SICKLECELLDISEASE", "MYOCARDIALINFARCTION", "DIABETESUNCOMPLICATED",
    "CARDIOMYOPATHIES", "HYPERTENSION", "OTHERIMMUNOCOMPROMISED", "PULMONARYEMBOLISM",
    "TOBACCOSMOKER", "SOLIDORGANORBLOODSTEMCELLTRANSPLANT",
)
CONDITION_SUFFIX = "_before_or_day_of_covid_indicator"

STUDY_CUTOFF = "2001-12-31"
DEATH_BEFORE = "2001-01-01"
DAY_ORIGIN = "1995-01-01"


def _max_flag(predicate) -> F.Column:
    return F.max(indicator(predicate))


@dataclass
class Study:
    """Lazily built study inputs over one data folder.

    With ``materialise`` the tables behind several others (index events, person history) are
    written once on first use, so that a query built from many of them does not repeat the join of
    orders and lines for each.
    """

    spark: SparkSession
    folder: str
    materialise: bool = False

    def keep(self, df: DataFrame) -> DataFrame:
        return checkpointed(df) if self.materialise else df

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def persons(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("person_id"),
            (F.col("c_nationkey") % 5).alias("site_id"),
            F.when(key % 41 != 0, F.floor((F.col("c_acctbal") + 1000) / 110).cast("int")).alias("age"),
            F.when(key % 17 == 0, None).when(key % 2 == 0, "MALE").otherwise("FEMALE").alias("sex"),
            F.col("c_mktsegment").alias("race_ethnicity"),
            F.when(key % 23 != 0, indicator(F.col("c_acctbal") > 8000)).alias("morbid_obesity"),
            indicator(key % 59 == 0).alias("possible_case"),
        )

    @cached_property
    def micro_visits(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            F.col("o_custkey").alias("person_id"),
            F.col("o_orderkey").alias("visit_id"),
            day.alias("visit_start_date"),
            F.when(F.col("o_orderstatus") == "F", F.trunc(day, "quarter")).alias("macrovisit_start_date"),
            F.col("o_orderpriority").alias("kind"),
            F.col("o_totalprice").alias("cost"),
        )

    @cached_property
    def visits(self) -> DataFrame:
        return self.micro_visits.select("person_id", "visit_start_date")

    @cached_property
    def index_events(self) -> DataFrame:
        day = F.col("visit_start_date")
        return self.keep(self.micro_visits.groupBy("person_id").agg(
            F.min(F.when(F.col("kind") == "1-URGENT", day)).alias("pos_date"),
            F.min(F.when(F.col("kind") == "4-NOT SPECIFIED", day)).alias("neg_date"),
            F.min(day).alias("first_visit_date"),
            F.max(day).alias("last_visit_date"),
            F.count(F.when(F.col("kind") == "3-MEDIUM", 1)).alias("doses"),
        ))

    @cached_property
    def deaths(self) -> DataFrame:
        return self.index_events.filter(F.col("last_visit_date") < F.lit(DEATH_BEFORE).cast("date")).select(
            "person_id", F.col("last_visit_date").alias("death_date")
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        """Per order: a bitmap of the conditions its lines carry and its number of returned lines."""
        bit = F.expr(f"shiftleft(1L, CAST(l_partkey % {len(CONDITIONS)} AS INT))")
        return self.table("lineitem").groupBy("l_orderkey").agg(
            F.bit_or(bit).alias("conditions"),
            F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"),
        )

    @cached_property
    def person_days(self) -> DataFrame:
        """One row per person and visit day."""
        kind, cost = F.col("kind"), F.col("cost")
        return (
            self.micro_visits.join(self.order_lines, F.col("visit_id") == F.col("l_orderkey"), "left")
            .groupBy("person_id", "visit_start_date")
            .agg(
                F.count("*").alias("visits"),
                F.count(F.when(kind == "3-MEDIUM", 1)).alias("doses"),
                _max_flag((kind == "5-LOW") & (cost > 350000)).alias("dx"),
                _max_flag((kind == "2-HIGH") & (cost > 400000)).alias("clinic"),
                _max_flag((kind == "3-MEDIUM") & (cost > 480000)).alias("phenotype"),
                _max_flag((kind == "1-URGENT") & (cost > 450000)).alias("hospital"),
                F.bit_or("conditions").alias("conditions"),
                F.sum(F.coalesce("returned", F.lit(0))).alias("returned"),
                F.count("returned").alias("with_lines"),
            )
        )

    @cached_property
    def _history(self) -> DataFrame:
        """Per person: totals, and what happened before, on and after the positive index date, if any."""
        gap = F.datediff("visit_start_date", "pos_date")
        index = self.index_events.select("person_id", "pos_date")
        day = F.col("visit_start_date")
        return self.keep(
            self.person_days.join(index, "person_id")
            .groupBy("person_id", "pos_date")
            .agg(
                F.sum(F.when(gap < 0, F.col("visits"))).cast("int").alias("visits_before"),
                F.datediff(F.max(F.when(gap <= 0, day)), F.min(F.when(gap <= 0, day))).alias("observation_before"),
                F.datediff(F.max(day), F.first("pos_date")).alias("observation_post"),
                F.max(F.when(gap > 0, F.col("dx"))).alias("dx"),
                F.max(F.when(gap > 0, F.col("clinic"))).alias("clinic"),
                F.max(F.when(gap > 0, F.col("phenotype"))).alias("phenotype"),
                F.max(F.when(gap >= 0, F.col("hospital"))).alias("hospitalised"),
                F.sum(F.when(gap <= 0, F.col("doses")).otherwise(0)).cast("int").alias("vaccine_doses"),
                F.bit_or(F.when(gap <= 0, F.col("conditions"))).alias("conditions"),
                F.sum(F.when(gap <= 0, F.col("returned"))).cast("int").alias("returned"),
                F.sum(F.when(gap <= 0, F.col("with_lines")).otherwise(0)).alias("with_lines"),
                F.sum("returned").cast("int").alias("returned_total"),
                F.sum("with_lines").alias("with_lines_total"),
            )
        )

    @cached_property
    def _positive_history(self) -> DataFrame:
        return self._history.filter("pos_date IS NOT NULL")

    @cached_property
    def positive_facts(self) -> DataFrame:
        """One row per index-positive person, with one nullable indicator per condition."""
        condition_flags = [
            F.when(
                (F.col("person_id") + i) % 53 != 0,
                F.expr(f"CAST(shiftright(coalesce(conditions, 0L), {i}) & 1L AS INT)"),
            ).alias(name + CONDITION_SUFFIX)
            for i, name in enumerate(CONDITIONS)
        ]
        died = self.deaths.select("person_id", F.lit(1).alias("death"))
        return (
            self._positive_history.join(self.persons, "person_id")
            .join(died, "person_id", "left")
            .select(
                "person_id", "site_id", "age", "sex", "race_ethnicity",
                F.col("pos_date").alias("index_date"),
                "dx", "clinic", "phenotype", "hospitalised", "visits_before", "observation_before",
                "observation_post", "morbid_obesity", "vaccine_doses",
                F.coalesce("death", F.lit(0)).alias("death"),
                *condition_flags,
            )
        )

    @cached_property
    def all_facts(self) -> DataFrame:
        """One row per person; the index date of the negative arm is ``neg_date``."""
        died = self.deaths.select("person_id", F.lit(1).alias("death"))
        dx = (
            self.micro_visits.filter((F.col("kind") == "5-LOW") & (F.col("cost") > 350000))
            .select("person_id").distinct().withColumn("dx", F.lit(1))
        )
        return (
            self.persons.join(self.index_events, "person_id", "left")
            .join(died, "person_id", "left")
            .join(dx, "person_id", "left")
            .select(
                "person_id", "site_id", "age", "sex", "race_ethnicity", "morbid_obesity", "neg_date",
                F.datediff("last_visit_date", "first_visit_date").alias("observation_period"),
                indicator(F.col("pos_date").isNotNull()).alias("confirmed_case"),
                "possible_case",
                F.coalesce("dx", F.lit(0)).alias("dx"),
                F.col("doses").cast("int").alias("vaccine_doses"),
                F.coalesce("death", F.lit(0)).alias("death"),
            )
        )

    @cached_property
    def comorbidity_positive(self) -> DataFrame:
        """Score up to the index date; persons without any line have no row."""
        return self._positive_history.filter("with_lines > 0").select(
            "person_id", F.col("returned").alias("comorbidity_score")
        )

    @cached_property
    def comorbidity_all(self) -> DataFrame:
        return self._history.filter("with_lines_total > 0").select(
            "person_id", F.col("returned_total").alias("comorbidity_score")
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Rows with a true label and a deterministic, heavily tied score in [0, 1]."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("row_id"),
            indicator(F.col("o_orderstatus") == "F").alias("y"),
            F.round(F.col("o_totalprice") / 500000, 3).alias("score"),
        )
