"""The study's cohorts over one set of inputs: arms, pre-match tables, funnels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import any_flag, min_gap_days
from ..operators import cohorts
from ..sources.study import DAY_ORIGIN, Study

TWO_FLAGS = ("dx", "clinic")
THREE_FLAGS = ("dx", "clinic", "phenotype")


@dataclass
class Arms:
    study: Study

    @cached_property
    def cases(self) -> DataFrame:
        return self.study.keep(cohorts.case_cohort(self.study.positive_facts, self.study.visits, THREE_FLAGS))

    @cached_property
    def positive(self) -> DataFrame:
        return self.study.keep(
            cohorts.positive_control(self.study.positive_facts, self.study.visits, self.cases)
        )

    @cached_property
    def negative(self) -> DataFrame:
        return self.study.keep(cohorts.negative_control(
            self.study.all_facts, self.study.visits, self.study.micro_visits, self.cases
        ))

    @cached_property
    def pre_match_positive(self) -> DataFrame:
        return cohorts.pre_match(
            self.cases.withColumnRenamed("observation_post", "observation_period"),
            self.positive.withColumnRenamed("observation_post", "observation_period"),
            DAY_ORIGIN,
        )

    @cached_property
    def pre_match_negative(self) -> DataFrame:
        return cohorts.pre_match(
            self.cases.withColumnRenamed("observation_post", "observation_period"), self.negative, DAY_ORIGIN
        )

    @cached_property
    def cohort_2a(self) -> DataFrame:
        return cohorts.flag_cohort(self.study.positive_facts, TWO_FLAGS)

    @cached_property
    def cohort_2b(self) -> DataFrame:
        return cohorts.flag_cohort(self.study.positive_facts, THREE_FLAGS)

    @cached_property
    def case_funnel(self) -> DataFrame:
        df = cohorts.attach_latest(
            self.study.positive_facts, self.study.visits, "person_id", "visit_start_date", "latest_visit_date"
        )
        return cohorts.funnel(df, [
            ("adult", F.col("age") >= 18),
            ("followed", min_gap_days("latest_visit_date", "index_date", 45)),
            ("flagged", any_flag(THREE_FLAGS)),
        ])

    def flag_funnel(self, flags) -> DataFrame:
        return cohorts.funnel(self.study.positive_facts, [("adult", F.col("age") >= 18), ("flagged", any_flag(flags))])
