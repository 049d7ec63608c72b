"""Every registered query: a function of (session, data folder) giving a DataFrame."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import attribution, boosting, cohorts, describe, evaluate, features, glm, matching, models, survival
from ..runtime import checkpointed
from ..sources.study import CONDITION_SUFFIX, CONDITIONS, STUDY_CUTOFF, Study
from .arms import THREE_FLAGS, TWO_FLAGS, Arms

QUERIES = {}

# Segment names of the test tables in the roles of race/ethnicity levels.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_REPORT = {"BUILDING": "Construction", "HOUSEHOLD": "Household", "MACHINERY": "Machines"}
SEGMENT_LEVELS = {
    "race_building": ("BUILDING",),
    "race_household": ("HOUSEHOLD",),
    "race_machinery": ("MACHINERY",),
    "race_other": ("AUTOMOBILE", "FURNITURE"),
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def arms(spark: SparkSession, folder: str, materialise: bool = True) -> Arms:
    return Arms(Study(spark, folder, materialise))


@query
def latest_visit(spark: SparkSession, folder: str) -> DataFrame:
    return cohorts.latest_event(Study(spark, folder).visits, "person_id", "visit_start_date", "latest_visit_date")


@query
def first_last_visit(spark, folder):
    return cohorts.first_last_event(
        Study(spark, folder).visits, "person_id", "visit_start_date", "first_visit_date", "last_visit_date"
    )


@query
def attach_latest_visit(spark, folder):
    s = Study(spark, folder)
    return cohorts.attach_latest(
        s.persons.select("person_id", "age", "sex"), s.visits, "person_id", "visit_start_date", "latest_visit_date"
    )


@query
def consolidate_visits(spark, folder):
    return cohorts.consolidate_visits(Study(spark, folder).micro_visits, keep_id="visit_id")


@query
def keep_first_visit(spark, folder):
    visits = Study(spark, folder).micro_visits.filter("macrovisit_start_date IS NOT NULL")
    return cohorts.keep_first(
        visits.select("person_id", "macrovisit_start_date", "visit_start_date", "visit_id", "kind"),
        ["person_id", "macrovisit_start_date"], ["visit_start_date", "visit_id"],
    )


@query
def dedup_visits(spark, folder):
    visits = Study(spark, folder).micro_visits.filter("macrovisit_start_date IS NULL")
    return cohorts.dedup(visits.select("person_id", "visit_start_date"), ["person_id", "visit_start_date"])


def _history(spark, folder):
    s = Study(spark, folder)
    index = s.all_facts.filter("neg_date IS NOT NULL").select("person_id", F.col("neg_date").alias("index_date"))
    return cohorts.visit_history(cohorts.consolidate_visits(s.micro_visits), index)


@query
def visits_before_index(spark, folder):
    return _history(spark, folder).filter("visits_before IS NOT NULL").select("person_id", "visits_before")


@query
def observation_before_index(spark, folder):
    return _history(spark, folder).filter("observation_before IS NOT NULL").select("person_id", "observation_before")


@query
def log_visit_rate(spark, folder):
    return X.rounded(_history(spark, folder).select(
        "person_id",
        X.safe_rate("visits_before", "observation_before").alias("visit_rate"),
        X.log_rate("visits_before", "observation_before").alias("log_visit_rate"),
    ))


CASE_COLUMNS = ("person_id", "site_id", "age", "sex", "race_ethnicity", "index_date", "latest_visit_date",
                "milestone_date", "dx", "clinic", "phenotype", "visits_before", "observation_before",
                "observation_post", "death", "morbid_obesity", "vaccine_doses", "is_case", "visit_rate",
                "log_visit_rate")
NEGATIVE_COLUMNS = ("person_id", "site_id", "age", "sex", "index_date", "latest_visit_date", "milestone_date",
                    "observation_period", "visits_before", "observation_before", "is_dx_site", "death",
                    "morbid_obesity", "vaccine_doses", "is_case", "visit_rate", "log_visit_rate")


@query
def case_cohort(spark, folder):
    return X.rounded(arms(spark, folder, False).cases.select(*CASE_COLUMNS))


@query
def positive_control(spark, folder):
    return X.rounded(arms(spark, folder).positive.select(*CASE_COLUMNS, "is_dx_site"))


@query
def negative_control(spark, folder):
    return X.rounded(arms(spark, folder).negative.select(*NEGATIVE_COLUMNS))


@query
def flag_cohort_2(spark, folder):
    return arms(spark, folder, False).cohort_2a.select("person_id", "age", "dx", "clinic", "phenotype")


@query
def flag_cohort_3(spark, folder):
    return arms(spark, folder, False).cohort_2b.select("person_id", "age", "dx", "clinic", "phenotype")


# Practices stand for sites where the test tables' five sites would make the answer trivial.
PRACTICE = "person_id DIV 5 AS practice_id"


@query
def site_flag(spark, folder):
    """Persons of practices (five neighbouring persons each) where somebody has the diagnosis."""
    facts = Study(spark, folder).all_facts.selectExpr("person_id", PRACTICE, "dx")
    members = facts.filter(F.col("dx") == 1)
    return cohorts.in_set_flag(facts, members, "practice_id", "is_dx_site").select("person_id", "practice_id", "is_dx_site")


@query
def common_sites(spark, folder):
    a = arms(spark, folder)
    left, right = cohorts.common_keys(a.cases.selectExpr("person_id", PRACTICE), a.positive.selectExpr("person_id", PRACTICE), "practice_id")
    return left.withColumn("side", F.lit("case")).unionByName(right.withColumn("side", F.lit("control")))


@query
def attrition_funnel(spark, folder):
    return arms(spark, folder, False).case_funnel


@query
def attrition_funnel_2(spark, folder):
    return arms(spark, folder, False).flag_funnel(TWO_FLAGS)


@query
def attrition_funnel_3(spark, folder):
    return arms(spark, folder, False).flag_funnel(THREE_FLAGS)


@query
def cohort_disjoint(spark, folder):
    a = arms(spark, folder)
    return cohorts.disjoint_check({"case": a.cases, "positive": a.positive, "negative": a.negative})


@query
def cohort_overlap(spark, folder):
    a = arms(spark, folder)
    return cohorts.overlap(a.cohort_2a, a.cohort_2b)


@query
def label_consistency(spark, folder):
    """All index-positive persons held against the person table, and how many of them it does not know."""
    s = Study(spark, folder)
    positive = s.index_events.filter("pos_date IS NOT NULL")
    odd = cohorts.label_consistency(positive, s.all_facts)
    return positive.agg(F.count("*").alias("n_positive")).join(odd.agg(F.count("*").alias("n_inconsistent")))


@query
def pre_match_positive(spark, folder):
    return X.rounded(arms(spark, folder).pre_match_positive)


@query
def pre_match_negative(spark, folder):
    return X.rounded(arms(spark, folder).pre_match_negative)


@query
def cohort_summary(spark, folder):
    return _summary(arms(spark, folder, False).cases)


@query
def cohort_summary_negative(spark, folder):
    a = arms(spark, folder)
    s = a.study
    kept = a.negative.select("person_id").join(
        s.all_facts.select("person_id", "age", "sex", "race_ethnicity"), "person_id", "left"
    )
    return _summary(kept)


def _summary(df: DataFrame) -> DataFrame:
    return describe.cohort_summary(df, race_names=SEGMENT_REPORT, race_default="Other", stat_digits=6)


@query
def cohort_summary_positive(spark, folder):
    return _summary(arms(spark, folder).positive)


@query
def cohort_summary_2a(spark, folder):
    return _summary(arms(spark, folder, False).cohort_2a)


@query
def cohort_summary_2b(spark, folder):
    return _summary(arms(spark, folder, False).cohort_2b)


@query
def person_summary(spark, folder):
    """Table 1 over every person, with unknown ages and sexes."""
    return _summary(Study(spark, folder).persons)


@query
def category_share(spark, folder):
    return describe.category_share(Study(spark, folder).persons, "sex")


@query
def age_buckets(spark, folder):
    return features.bucket_flags(Study(spark, folder).persons.select("person_id", "age"))


@query
def age_groups(spark, folder):
    return features.age_groups(Study(spark, folder).persons.select("person_id", "age"))


@query
def one_hot(spark, folder):
    persons = Study(spark, folder).persons.select("person_id", "race_ethnicity")
    return features.one_hot(persons, "race_ethnicity", SEGMENT_LEVELS)


@query
def race_recode(spark, folder):
    return Study(spark, folder).persons.select(
        "person_id", X.recode("race_ethnicity", SEGMENT_REPORT, "Other").alias("race"), X.is_value("sex", "MALE").alias("male")
    )


def features_of(cohort: DataFrame) -> DataFrame:
    return features.feature_table(
        cohort,
        [c + CONDITION_SUFFIX for c in CONDITIONS],
        ["vaccine_doses", "hospitalised"],
        "death",
        SEGMENT_LEVELS,
        suffix=CONDITION_SUFFIX,
    )


@query
def feature_table_2a(spark, folder):
    return features_of(arms(spark, folder, False).cohort_2a)


@query
def feature_table_2b(spark, folder):
    return features_of(arms(spark, folder, False).cohort_2b)


@query
def mean_impute(spark, folder):
    table = _wide_table(spark, folder, False)
    return X.rounded(features.mean_impute(table, features.features_except(table, "person_id", "death")))


@query
def complete_cases(spark, folder):
    table = features_of(arms(spark, folder, False).cohort_2b)
    return features.complete_cases(table, features.features_except(table, "person_id")).select("person_id", "death")


@query
def fill_mean(spark, folder):
    persons = Study(spark, folder).persons.select("person_id", "age")
    return X.rounded(features.fill_mean(persons, ["age"]))


CORR_COLUMNS = ("vaccine_doses", "morbid_obesity", "dx", "clinic", "phenotype", "hospitalised", "death")


@query
def corr_matrix(spark, folder):
    return X.rounded(describe.corr_matrix(Study(spark, folder).positive_facts, CORR_COLUMNS))


@query
def corr_matrix_triangle(spark, folder):
    return X.rounded(describe.corr_matrix(Study(spark, folder).positive_facts, CORR_COLUMNS, triangle=True))


def unmatched_arms(spark, folder) -> DataFrame:
    """The three arms before matching, with their survival target: a large deterministic input."""
    a = arms(spark, folder)
    died = a.study.deaths.select("person_id", F.lit(1).alias("death"))
    stacked = cohorts.stack_arms(a.cases, a.positive, a.negative).join(died, "person_id", "left")
    stacked = stacked.withColumn("death", F.coalesce("death", F.lit(0)))
    return features.survival_target(stacked, a.study.deaths, STUDY_CUTOFF)


@query
def survival_target(spark, folder):
    return unmatched_arms(spark, folder)


def arm_name() -> F.Column:
    return (
        F.when(F.col("case_arm") == 1, "case").when(F.col("positive_arm") == 1, "positive").otherwise("negative")
    )


@query
def km_curve(spark, folder):
    df = unmatched_arms(spark, folder).withColumn("arm", arm_name())
    return X.rounded(survival.km_curve(df, "duration", "death", "arm"))


@query
def km_band(spark, folder):
    df = unmatched_arms(spark, folder).withColumn("arm", arm_name())
    return X.rounded(survival.km_band(survival.km_curve(df, "duration", "death", "arm"), "arm"))


@query
def holdout_split(spark, folder):
    return evaluate.holdout(Study(spark, folder).scored.select("row_id"), "row_id")


@query
def stratified_folds(spark, folder):
    return evaluate.stratified_folds(Study(spark, folder).scored.select("row_id", "y"), "y", "row_id")


def _scores(spark, folder) -> DataFrame:
    return evaluate.score_table(Study(spark, folder).scored)


@query
def roc_curve(spark, folder):
    return X.rounded(evaluate.roc_curve(_scores(spark, folder)))


@query
def roc_auc(spark, folder):
    return X.rounded(evaluate.roc_auc(_scores(spark, folder)))


@query
def pr_curve(spark, folder):
    return X.rounded(evaluate.pr_curve(_scores(spark, folder)))


@query
def threshold_sweep(spark, folder):
    return X.rounded(evaluate.threshold_sweep(_scores(spark, folder)))


@query
def best_threshold(spark, folder):
    return X.rounded(evaluate.best_threshold(evaluate.threshold_sweep(_scores(spark, folder))))


@query
def confusion_matrix(spark, folder):
    return evaluate.confusion(Study(spark, folder).scored, 0.132)


@query
def recall_at_cutoff(spark, folder):
    return X.rounded(evaluate.recall_at(Study(spark, folder).scored, 0.132))


def _fold_scores(spark, folder) -> DataFrame:
    folds = evaluate.stratified_folds(Study(spark, folder).scored, "y", "row_id")
    return evaluate.score_table(folds, by=["repeat", "fold"])


@query
def mean_roc(spark, folder):
    return X.rounded(evaluate.mean_roc(_fold_scores(spark, folder), ["repeat", "fold"]))


@query
def fold_auc(spark, folder):
    return X.rounded(evaluate.roc_auc(_fold_scores(spark, folder), ["repeat", "fold"]))


@query
def auc_stats(spark, folder):
    return X.rounded(evaluate.auc_stats(_fold_scores(spark, folder), ["repeat", "fold"]))


CALIPERS = {"age": 10, "index_day": 45, "log_visit_rate": 1}


def _given_score(pre: DataFrame) -> DataFrame:
    """A heavily tied whole-number score, so that a SQL engine can follow the same matching."""
    return X.rounded(pre).withColumn("distance", (F.col("index_day") + 3 * F.col("age")).cast("double"))


def given_score_pairs(a: Arms, arm: str) -> tuple[DataFrame, DataFrame]:
    pre = _given_score(a.pre_match_positive if arm == "positive" else a.pre_match_negative)
    pre = checkpointed(pre)
    return pre, matching.match_nearest(pre, "is_case", "distance", "site_id", CALIPERS)


@query
def match_pairs_positive(spark, folder):
    return given_score_pairs(arms(spark, folder), "positive")[1]


@query
def match_pairs_negative(spark, folder):
    return given_score_pairs(arms(spark, folder), "negative")[1]


# So few rows per chunk that the walks over chunks and the rounds of acceptance run on small tables too.
SMALL_CHUNK = 300


@query
def match_pairs_positive_chunked(spark, folder):
    pre = checkpointed(_given_score(arms(spark, folder).pre_match_positive))
    return matching.match_nearest(pre, "is_case", "distance", "site_id", CALIPERS, chunk_rows=SMALL_CHUNK)


@query
def match_pairs_negative_chunked(spark, folder):
    pre = checkpointed(_given_score(arms(spark, folder).pre_match_negative))
    return matching.match_nearest(pre, "is_case", "distance", "site_id", CALIPERS, chunk_rows=SMALL_CHUNK)


@query
def nearest_control(spark, folder):
    """Each case's nearest control inside the calipers, controls being shared."""
    pre = checkpointed(_given_score(arms(spark, folder).pre_match_negative))
    return matching.match_nearest(pre, "is_case", "distance", "site_id", CALIPERS, replace=True)


@query
def matched_data(spark, folder):
    pre, pairs = given_score_pairs(arms(spark, folder), "negative")
    return matching.matched_data(pre, pairs).select(
        "person_id", "site_id", "age", "index_date", "is_case", "index_day", "distance", "weights", "subclass"
    )


def given_score_arms(a: Arms) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched cases and both matched control arms, matching on the given score."""
    pre_pos, pairs_pos = given_score_pairs(a, "positive")
    pre_neg, pairs_neg = given_score_pairs(a, "negative")
    m_pos = checkpointed(matching.matched_data(pre_pos, pairs_pos))
    m_neg = checkpointed(matching.matched_data(pre_neg, pairs_neg))
    cases = cohorts.matched_cases(a.cases.select("person_id", "index_date"), m_pos, m_neg)
    cases = checkpointed(cases)
    return cases, cohorts.matched_controls(m_pos, cases), cohorts.matched_controls(m_neg, cases)


@query
def matched_cases(spark, folder):
    return given_score_arms(arms(spark, folder))[0]


@query
def matched_controls(spark, folder):
    _, positive, negative = given_score_arms(arms(spark, folder))
    columns = ["person_id", "subclass", "index_date", "distance"]
    return positive.select(*columns, F.lit("positive").alias("arm")).unionByName(
        negative.select(*columns, F.lit("negative").alias("arm"))
    )


@query
def matched_disjoint(spark, folder):
    case, positive, negative = given_score_arms(arms(spark, folder))
    return cohorts.disjoint_check({"case": case, "positive": positive, "negative": negative})


def given_score_cohort(spark, folder) -> DataFrame:
    a = arms(spark, folder)
    s = a.study
    case, positive, negative = given_score_arms(a)
    return cohorts.analysis_cohort(
        case, positive, negative, s.positive_facts, s.all_facts, s.comorbidity_positive, s.comorbidity_all,
        a.negative.select("person_id", "observation_before", "visits_before"),
    )


@query
def analysis_cohort(spark, folder):
    return X.rounded(given_score_cohort(spark, folder))


def study_cohort(spark, folder) -> DataFrame:
    """The analysis cohort over the whole arms, before any matching thins them out."""
    a = arms(spark, folder)
    s = a.study
    return cohorts.analysis_cohort(
        a.cases, a.positive, a.negative, s.positive_facts, s.all_facts, s.comorbidity_positive, s.comorbidity_all,
        a.negative.select("person_id", "observation_before", "visits_before"),
    )


MODEL_COLUMNS = ("comorbidity_score", "case_arm", "positive_arm", "negative_arm", "vaccine_doses")
COX_COLUMNS = ("comorbidity_score", "case_arm", "positive_arm", "vaccine_doses")
FORMULA = ("case_arm", "positive_arm", "negative_arm", "vaccine_doses", "comorbidity_score")


@query
def analysis_cohort_unmatched(spark, folder):
    return X.rounded(study_cohort(spark, folder))


@query
def corr_matrix_cohort(spark, folder):
    columns = ("comorbidity_score", "morbid_obesity", "case_arm", "positive_arm", "negative_arm", "vaccine_doses", "death")
    return X.rounded(describe.corr_matrix(study_cohort(spark, folder), columns, triangle=True))


@query
def corr_matrix_matched(spark, folder):
    columns = ("comorbidity_score", "morbid_obesity", "case_arm", "positive_arm", "negative_arm", "vaccine_doses", "death")
    return X.rounded(describe.corr_matrix(checkpointed(given_score_cohort(spark, folder)), columns, triangle=True))


@query
def odds_ratio_matched(spark, folder):
    """The one-predictor odds ratio over the matched arms."""
    table = glm.glm_binomial(checkpointed(given_score_cohort(spark, folder)), "death", ["case_arm"], ci="wald")
    return X.rounded(table.select("term", "estimate", "std_error", "conf_low", "conf_high"))


@query
def km_curve_matched(spark, folder):
    cohort = checkpointed(given_score_cohort(spark, folder))
    target = features.survival_target(cohort, Study(spark, folder).deaths, STUDY_CUTOFF).withColumn("arm", arm_name())
    return X.rounded(survival.km_curve(target, "duration", "death", "arm"))


def _with_propensity(pre: DataFrame) -> DataFrame:
    covariates = ["site_id", "age", "log_visit_rate", "index_day"]
    return matching.propensity(checkpointed(pre), "is_case", covariates)


@query
def propensity(spark, folder):
    """Fitted propensity of being a case, for cases and index-positive controls."""
    return _with_propensity(arms(spark, folder).pre_match_positive).select("person_id", "is_case", "distance")


@query
def propensity_by_site(spark, folder):
    """The same with the site as a factor: one intercept per site."""
    pre = arms(spark, folder).pre_match_positive
    scored = matching.propensity_by_group(pre, "is_case", ["age", "log_visit_rate", "index_day"], "site_id")
    return scored.select("person_id", "site_id", "is_case", "distance")


def propensity_matched(pre: DataFrame) -> DataFrame:
    scored = checkpointed(_with_propensity(pre))
    return matching.matched_data(scored, matching.match_nearest(scored, "is_case", "distance", "site_id", CALIPERS))


def matched_study(spark, folder) -> DataFrame:
    """Arms to propensity-matched analysis cohort, end to end."""
    a = arms(spark, folder)
    s = a.study
    m_pos = checkpointed(propensity_matched(a.pre_match_positive))
    m_neg = checkpointed(propensity_matched(a.pre_match_negative))
    cases = checkpointed(cohorts.matched_cases(a.cases.select("person_id", "index_date"), m_pos, m_neg))
    return cohorts.analysis_cohort(
        cases, cohorts.matched_controls(m_pos, cases), cohorts.matched_controls(m_neg, cases),
        s.positive_facts, s.all_facts, s.comorbidity_positive, s.comorbidity_all,
        a.negative.select("person_id", "observation_before", "visits_before"),
    )


@query
def propensity_matched_cohort(spark, folder):
    return matched_study(spark, folder)


@query
def odds_ratio_single(spark, folder):
    table = glm.glm_binomial(study_cohort(spark, folder), "death", ["morbid_obesity"], ci="wald")
    return X.rounded(table.select("term", "estimate", "std_error", "statistic", "conf_low", "conf_high"))


@query
def odds_ratio_single_profile(spark, folder):
    table = glm.glm_binomial(study_cohort(spark, folder), "death", ["morbid_obesity"])
    return X.rounded(table.select("term", "estimate", "std_error", "conf_low", "conf_high", "conf_method"))


@query
def odds_ratio_table_single(spark, folder):
    """The forest-plot table of the one-predictor model, rows with an upper limit of at most 1 only."""
    fit = glm.glm_binomial(study_cohort(spark, folder), "death", ["morbid_obesity"], ci="wald")
    table = describe.odds_ratio_table(fit, max_high=1)
    return X.rounded(table.select("term", "estimate", "conf_low", "conf_high", "significance"))


@query
def odds_ratio_multi(spark, folder):
    return glm.glm_binomial(study_cohort(spark, folder), "death", FORMULA)


@query
def odds_ratio_table(spark, folder):
    return describe.odds_ratio_table(glm.glm_binomial(study_cohort(spark, folder), "death", FORMULA))


def _wide_table(spark, folder, three: bool) -> DataFrame:
    a = arms(spark, folder, False)
    return checkpointed(features_of(a.cohort_2b if three else a.cohort_2a))


@query
def odds_ratio_table_2a(spark, folder):
    table = _wide_table(spark, folder, False)
    fit = glm.glm_binomial(table, "death", features.features_except(table, "person_id", "death"))
    return describe.odds_ratio_table(fit, max_high=10)


@query
def odds_ratio_table_2b(spark, folder):
    table = _wide_table(spark, folder, True)
    fit = glm.glm_binomial(table, "death", features.features_except(table, "person_id", "death"))
    return describe.odds_ratio_table(fit)


@query
def cox_summary(spark, folder):
    cohort = study_cohort(spark, folder)
    target = features.survival_target(cohort, Study(spark, folder).deaths, STUDY_CUTOFF)
    return survival.cox_summary(spark, survival.cox_fit(target, "duration", "death", COX_COLUMNS))


def _model_table(spark, folder) -> DataFrame:
    cohort = study_cohort(spark, folder).select("person_id", "death", *MODEL_COLUMNS)
    return checkpointed(features.complete_cases(cohort, MODEL_COLUMNS))


def _logistic_cv(spark, folder, table: DataFrame | None = None) -> DataFrame:
    table = _model_table(spark, folder) if table is None else table
    xs = features.features_except(table, "person_id", "death")
    folds = evaluate.stratified_folds(table, "death", "person_id")
    folds = models.prepared_folds(folds, xs, ["person_id", "death"])
    fits = models.cross_fit(folds, models.logistic("death"))
    return checkpointed(models.cross_score(folds, fits, ["person_id", "death"]))


@query
def logistic_cv_scores(spark, folder):
    return _logistic_cv(spark, folder)


@query
def logistic_cv(spark, folder):
    """Mean ROC curve of the 25 held-out folds of the five-feature logistic model."""
    table = evaluate.score_table(_logistic_cv(spark, folder), y="death", by=["repeat", "fold"])
    return evaluate.mean_roc(table, ["repeat", "fold"])


@query
def logistic_cv_2a(spark, folder):
    table = _wide_table(spark, folder, False)
    table = features.mean_impute(table, features.features_except(table, "person_id", "death"))
    table = evaluate.score_table(_logistic_cv(spark, folder, table), y="death", by=["repeat", "fold"])
    return evaluate.auc_stats(table, ["repeat", "fold"])


@query
def logistic_features(spark, folder):
    """The features of the wide table, with how many rows know each."""
    table = _wide_table(spark, folder, False)
    return models.feature_list(table, features.features_except(table, "person_id", "death"))


def _holdout_scores(spark, folder, fitter, table: DataFrame, xs) -> tuple[object, DataFrame]:
    data = checkpointed(models.assemble(evaluate.holdout(table, "person_id"), xs).select("person_id", "death", "is_test", "x"))
    model = fitter(data.filter("is_test = 0"))
    return model, models.score(model, data.filter("is_test = 1"), ["person_id", "death"])


@query
def logistic_holdout(spark, folder):
    """Confusion matrix of the logistic model on the held-out fifth."""
    _, scored = _holdout_scores(spark, folder, models.logistic("death"), _model_table(spark, folder), MODEL_COLUMNS)
    return evaluate.confusion(scored, models.LOGISTIC_CUTOFF, y="death")


# The three analyses' tables; hold-outs take an untuned booster, cross-validation the tuned one, over 5 x 5 folds.
def _tree_table(spark, folder, analysis: str = "2a") -> tuple[DataFrame, list[str]]:
    table = _model_table(spark, folder) if analysis == "1" else _wide_table(spark, folder, analysis == "2b")
    return table, features.features_except(table, "person_id", "death")


def _tree_cv(spark, folder, analysis: str = "2a", params: boosting.TreeParams = boosting.TreeParams()):
    table, xs = _tree_table(spark, folder, analysis)
    folds = boosting.prepare(evaluate.stratified_folds(table, "death", "person_id", k=5, repeats=5), xs, "death", ["person_id"])
    return folds, xs, boosting.fit(folds, params)


def _tree_holdout(spark, folder, analysis: str):
    table, xs = _tree_table(spark, folder, analysis)
    split = evaluate.holdout(table, "person_id").withColumns({"repeat": F.lit(0), "fold": 1 - F.col("is_test")})
    folds = boosting.prepare(split, xs, "death", ["person_id"], [(0, 0)])
    forests = boosting.fit(folds, boosting.PLAIN_TREES)
    return forests[0, 0], boosting.cross_score(folds, forests, ["person_id", "death"]).select("person_id", "death", "score"), xs


def _tree_thresholds(spark, folder, analysis: str) -> DataFrame:
    _, scored, _ = _tree_holdout(spark, folder, analysis)
    return evaluate.best_threshold(evaluate.threshold_sweep(evaluate.score_table(checkpointed(scored), y="death")))


def _tree_confusion(spark, folder, analysis: str) -> DataFrame:
    _, scored, _ = _tree_holdout(spark, folder, analysis)
    return evaluate.confusion(scored, models.TREE_CUTOFFS[analysis], y="death")


def _tree_recall(spark, folder, analysis: str) -> DataFrame:
    _, scored, _ = _tree_holdout(spark, folder, analysis)
    return evaluate.recall_at(scored, models.TREE_CUTOFFS[analysis], y="death")


def _tree_importance(spark, folder, analysis: str) -> DataFrame:
    model, _, xs = _tree_holdout(spark, folder, analysis)
    return models.importance_top(boosting.importance(spark, model, xs))


def _tree_split_counts(spark, folder, analysis: str) -> DataFrame:
    model, _, xs = _tree_holdout(spark, folder, analysis)
    return boosting.split_counts(spark, model, xs)


def _tree_mean_roc(spark, folder, analysis: str) -> DataFrame:
    folds, _, fits = _tree_cv(spark, folder, analysis)
    scores = checkpointed(boosting.cross_score(folds, fits, ["person_id", "death"]))
    return evaluate.mean_roc(evaluate.score_table(scores, y="death", by=["repeat", "fold"]), ["repeat", "fold"])


def _tree_fold_importance(spark, folder, analysis: str) -> DataFrame:
    _, xs, fits = _tree_cv(spark, folder, analysis)
    return models.fold_importance_wide(boosting.fold_importance(spark, fits, xs), 5)


def _tree_mean_importance(spark, folder, analysis: str) -> DataFrame:
    _, xs, fits = _tree_cv(spark, folder, analysis)
    return models.mean_importance_top(boosting.fold_importance(spark, fits, xs))


def _tree_attributions(spark, folder, analysis: str) -> DataFrame:
    folds, xs, fits = _tree_cv(spark, folder, analysis, boosting.ATTRIBUTION_TREES)
    return attribution.fold_attribution(folds, fits, ["person_id"], xs)


def _tree_attribution_summary(spark, folder, analysis: str) -> DataFrame:
    return attribution.attribution_summary(checkpointed(_tree_attributions(spark, folder, analysis)))


def _tree_attribution_quantiles(spark, folder, analysis: str) -> DataFrame:
    return attribution.attribution_quantiles(checkpointed(_tree_attributions(spark, folder, analysis)))


def _tree_attribution_scatter(spark, folder, analysis: str) -> DataFrame:
    return attribution.attribution_scatter(checkpointed(_tree_attributions(spark, folder, analysis)))


# (query's name, the analysis whose name has no ending, what it does)
TREE_QUERIES = (
    ("tree_holdout", None, _tree_thresholds), ("tree_confusion", None, _tree_confusion), ("tree_recall", None, _tree_recall),
    ("tree_importance", "2a", _tree_importance), ("tree_split_counts", "2b", _tree_split_counts), ("tree_cv", "2a", _tree_mean_roc),
    ("tree_cv_importance", "2a", _tree_fold_importance), ("tree_importance_top", "2a", _tree_mean_importance),
    ("attribution_tree", "2a", _tree_attributions), ("attribution_summary", "2a", _tree_attribution_summary),
    ("attribution_quantiles", "2a", _tree_attribution_quantiles),
    ("attribution_scatter", "2a", _tree_attribution_scatter),
)
for _name, _plain, _run in TREE_QUERIES:
    for _analysis in ("1", "2a", "2b"):
        QUERIES[_name if _analysis == _plain else f"{_name}_{_analysis}"] = partial(_run, analysis=_analysis)


@query
def attribution_linear(spark, folder):
    table = _model_table(spark, folder)
    model = models.logistic("death")(models.assemble(table, MODEL_COLUMNS))
    return attribution.linear_attribution(model.coefficients.toArray(), table, ["person_id"], MODEL_COLUMNS)


# The steps after a fit, on given coefficients and on importances that are shares of the order value.
GIVEN_COEFFICIENTS = (0.3, 0.8, -0.2, -0.6, -0.1)


def _given_attributions(spark, folder) -> DataFrame:
    table = _model_table(spark, folder)
    return attribution.linear_attribution(GIVEN_COEFFICIENTS, table, ["person_id"], MODEL_COLUMNS)


@query
def attribution_given(spark, folder):
    return X.rounded(_given_attributions(spark, folder))


@query
def attribution_summary_given(spark, folder):
    table = attribution.attribution_summary(checkpointed(_given_attributions(spark, folder)))
    return X.rounded(table.select("feature", "mean_abs", "direction"))


@query
def attribution_quantiles_given(spark, folder):
    return X.rounded(attribution.attribution_quantiles(checkpointed(_given_attributions(spark, folder)), k=4))


@query
def attribution_scatter_given(spark, folder):
    return X.rounded(attribution.attribution_scatter(checkpointed(_given_attributions(spark, folder)), k=4))


def _given_importance(spark, folder) -> DataFrame:
    orders = Study(spark, folder).table("orders").select(
        F.expr("CAST(o_orderkey % 5 AS INT) AS repeat"), F.expr("CAST((o_orderkey DIV 5) % 5 AS INT) AS fold"),
        F.expr("concat('f', o_custkey % 60) AS feature"), F.col("o_totalprice").cast("double").alias("price"))
    sums = checkpointed(orders.groupBy("repeat", "fold", "feature").agg(F.sum("price").alias("price")))
    totals = sums.groupBy("repeat", "fold").agg(F.sum("price").alias("total"))
    return sums.join(totals, ["repeat", "fold"]).select("repeat", "fold", "feature", (F.col("price") / F.col("total")).alias("importance"))


@query
def importance_by_fold_given(spark, folder):
    return X.rounded(models.fold_importance_wide(_given_importance(spark, folder), 5))


@query
def importance_mean_given(spark, folder):
    return X.rounded(models.mean_importance_top(_given_importance(spark, folder)))


@query
def importance_top_given(spark, folder):
    one = _given_importance(spark, folder).filter("repeat = 0 AND fold = 0").select("feature", "importance")
    return X.rounded(models.importance_top(one))
