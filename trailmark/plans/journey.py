"""The journey stages over one input, built lazily and kept once built.

``JourneyContext`` wires the operators the way the batch pipeline runs them:
events -> labels -> transitions -> state space -> self rates -> matrices.
Frames that several queries read (raw and cleaned events, transitions, drift
table, model pieces) are stage tables; everything else stays a lazy plan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import os

from trailmark.functions.exprs import major_group
from trailmark.operators import classify, clean, drift, labels, markov, transitions
from trailmark.session import stage_root
from trailmark.sources import stages, tables

# An event is one (person, label, date) after deduplication.
EVENT_KEY = ("person_id", "matched_label", "start_date")
FIXTURE_TABLES = ("lineitem", "orders", "part", "customer")

_CONTEXTS: dict = {}


def context(spark: SparkSession, sf_dir: str, **options) -> "JourneyContext":
    """The session's context of one input and options. Inputs are listed once
    per session; ``reset_contexts`` lists them anew."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(options.items())))
    if key not in _CONTEXTS:
        _CONTEXTS[key] = JourneyContext(spark, sf_dir, **options)
        first = _CONTEXTS.setdefault(key[:2], _CONTEXTS[key])
        _CONTEXTS[key].__dict__["fingerprint"] = first.fingerprint
    return _CONTEXTS[key]


def reset_contexts() -> None:
    _CONTEXTS.clear()


class JourneyContext:
    """Stages of the job-journey fixture over the driver tables of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str, space_from: str = "all",
                 scorer_rows: int | None = None, labels_from: str = "code", scores=None, threshold: float = classify.CONFIDENCE,
                 segment_method: str = "quantile"):
        """``space_from``: "all" builds the model's state space and self-loop
        rates from every transition, test included, as the batch program does;
        "train" uses the training transitions only (evaluation rows with a
        state outside that space then drop, C5). The learned reranker is fitted on every
        labelled training row; only a ``scorer_rows`` given by the caller bounds them
        (validation and test rows are never sampled). ``labels_from``
        (D1, I5): "code" builds the journey from events with a valid code;
        another name adds the uncoded events whose label in ``scores(context)``
        (key, predicted, confidence) reaches ``threshold``, and names the
        stages of that branch. ``segment_method``: "quantile" or "kmeans" (H3)."""
        if space_from not in ("all", "train"):
            raise ValueError("space_from must be 'all' or 'train'")
        if labels_from != "code" and scores is None:
            raise ValueError("labels from scores need scores")
        self.space_from = space_from
        self.labels_from, self.scores, self.threshold = labels_from, scores, threshold
        self.segment_method = segment_method
        self.scorer_rows = scorer_rows
        self.spark = spark
        self.sf_dir = sf_dir

    # --- inputs -----------------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        """The joined input events; a stage table."""
        return self._stage("raw", lambda: tables.job_events(self.spark, self.sf_dir))

    @cached_property
    def fingerprint(self) -> str:
        data = stages.input_signature(
            self.spark, [os.path.join(self.sf_dir, f"{t}.parquet") for t in FIXTURE_TABLES])
        return f"{data}-{stages.code_signature()}"

    #: Stages before the labels, the same in every branch.
    SHARED = ("raw", "events", "splits")

    def stage_path(self, name: str) -> str:
        branch = "" if self.labels_from == "code" or name in self.SHARED else f"labels-{self.labels_from}"
        return os.path.join(stage_root(self.spark), f"jobs-{self.fingerprint}", branch, name)

    def _stage(self, name: str, build, partition_by: list[str] | None = None, after: tuple[str, ...] = ()) -> DataFrame:
        """The stage, rebuilt if its inputs, the code or a stage it comes ``after`` changed."""
        return stages.stage(self.spark, self.stage_path(name), build, self.fingerprint, name,
                            partition_by=partition_by, after=[self.stage_path(n) for n in after])

    @cached_property
    def events(self) -> DataFrame:
        """Cleaned and labelled events (B1-B8), all rows; a stage table."""
        return self._stage("events", lambda: labels.assign_labels(
            clean.clean_events(self.raw, order=tables.JOB_EVENT_ORDER)), after=("raw",))

    @cached_property
    def coded_events(self) -> DataFrame:
        """The events the journey is built from, with their final state: those
        with a valid code (their code group) and, in a branch with scores, the
        uncoded ones whose label was accepted."""
        if self.labels_from == "code":
            return self.events.filter(~F.col("needs_nlp")).withColumn("state", F.col("occupation_group"))
        return self._stage("labelled", lambda: self.merged_events(self.scores(self), self.threshold), after=("events",))

    @cached_property
    def univ_flags(self) -> DataFrame:
        return transitions.majority_flag(self.coded_events)

    @cached_property
    def transitions(self) -> DataFrame:
        """Transitions of the coded events with the entity flag; a stage table."""
        # what transitions are made of; the texts of an event stay in its table
        cols = [c for c in ("person_id", "yr", "start_date", "matched_label", "state", "label_source") if c in self.coded_events.columns]
        return self._stage("transitions", lambda: transitions.attach_flag(
            transitions.build_transitions(self.coded_events.select(*cols)), self.univ_flags), after=("events",))

    # --- model pieces over all transitions --------------------------------
    @cached_property
    def space(self) -> DataFrame:
        return self._stage("space", lambda: transitions.state_space(self.transitions), after=("transitions",))

    @cached_property
    def rates(self) -> DataFrame:
        return self._stage("rates", lambda: transitions.self_rates(self.transitions, self.space), after=("transitions",))

    @cached_property
    def global_matrix(self) -> DataFrame:
        return markov.transition_matrix(self.transitions, self.space, self.rates)

    @cached_property
    def logprob(self) -> DataFrame:
        return drift.transition_logprob(self.transitions, self.global_matrix, self.space)

    @cached_property
    def risk(self) -> DataFrame:
        return self._stage("risk", lambda: drift.drift_scores(self.logprob, self.coded_events), after=("transitions",))

    def merged_events(self, scored: DataFrame, threshold: float) -> DataFrame:
        """Coded events and uncoded ones labelled by ``scored``."""
        return labels.merge_fallback(self.events, scored, EVENT_KEY, threshold)

    # --- split and ensemble (train-only components) ----------------------
    window_size = 2      # the fixture spans 7 years
    seed = 42

    @cached_property
    def split(self) -> DataFrame:
        """(person_id, dominant, split); a stage table."""
        from trailmark.operators import ensemble
        return self._stage("split", lambda: ensemble.stratified_split(self.coded_events, self.seed))

    @cached_property
    def split_transitions(self) -> DataFrame:
        """Transitions with their entity's split, joined once and written
        partitioned by split: every model piece and scoring pass then reads
        its split as a pruned scan instead of joining again."""
        return self._stage("split_transitions", lambda: self.transitions.join(
            self.split.select("person_id", "split"), "person_id"), partition_by=["split"])

    def part(self, name: str) -> DataFrame:
        return self.split_transitions.filter(F.col("split") == name)

    @property
    def ens_tag(self) -> str:
        base = f"ens-w{self.window_size}-s{self.seed}"
        if self.segment_method != "quantile":
            base += f"-{self.segment_method}"
        return base if self.space_from == "all" else f"{base}-trainspace"

    @cached_property
    def model_space(self) -> DataFrame:
        if self.space_from == "all":
            return self.space
        return self._stage(f"{self.ens_tag}/space", lambda: transitions.state_space(self.part("train")))

    @cached_property
    def model_rates(self) -> DataFrame:
        if self.space_from == "all":
            return self.rates
        return self._stage(f"{self.ens_tag}/rates",
                           lambda: transitions.self_rates(self.part("train"), self.model_space))

    @cached_property
    def components(self):
        from trailmark.operators import ensemble
        tag = self.ens_tag
        return ensemble.Components(
            self.part("train"), self.model_space, self.model_rates, window_size=self.window_size, seed=self.seed,
            segment_method=self.segment_method, keep=lambda name, build: self._stage(f"{tag}/{name}", build))

    def annotated(self, name: str) -> DataFrame:
        from trailmark.operators import ensemble
        return ensemble.annotate(self.part(name), self.components)

    @cached_property
    def weights(self) -> DataFrame:
        from trailmark.operators import ensemble
        return self._stage(f"{self.ens_tag}/weights", lambda: ensemble.tune_weights(
            self.annotated("val"), self.components, self.model_rates))

    # --- rerank data path (J2-J13) ----------------------------------------
    @cached_property
    def state_embeddings(self) -> DataFrame:
        """Unit-length vector per state index from the state's text."""
        from trailmark.operators import classify, rerank
        names = self.model_space.select("state", "idx", F.concat_ws(" ", "state", major_group("state")).alias("name"))
        return self._stage(f"{self.ens_tag}/state-vectors", lambda: rerank.state_embeddings_from_text(
            names, lambda df, col: classify.hashed_embedding(df, col, "state_idx")))

    def candidate_features(self, name: str) -> DataFrame:
        """(row, candidate) features of one split, from its lists (a stage table).
        Training rows get the true next forced into the list, evaluation rows do
        not. The features are expressions over the lists and small tables: they are
        not written, at K rows a row they would be the largest table of all."""
        from trailmark.operators import rerank
        return rerank.candidate_features(self._candidate_lists(name), self.components, self.state_embeddings, None)

    def feature_lists(self, name: str) -> DataFrame:
        """The features of ``candidate_features`` with each row's candidates kept together: nothing is shuffled to rank them."""
        from trailmark.operators import rerank
        return rerank.feature_lists(transitions.temporal_features(self._candidate_lists(name)), self.components, self.state_embeddings)

    def _ranked_rows(self, name: str) -> DataFrame:
        """All rows of the split, with their entity's years (of the training split fewer only if ``scorer_rows`` was given)."""
        from trailmark.operators import rerank
        rows = self.annotated(name)
        if name == "train" and self.scorer_rows is not None:
            rows = rerank.capped_rows(rows, self.scorer_rows, self.seed)
        # the years meet rows, not lists
        return rows.join(transitions.entity_years(self.transitions), "person_id")

    def _lists_stage(self, kind: str, name: str, build) -> DataFrame:
        return self._stage(f"{self.ens_tag}/{kind}-{name}-{'all' if self.scorer_rows is None else self.scorer_rows}", build)

    def _context_candidates(self, name: str) -> DataFrame:
        """The lists of the contexts of an evaluation split, written once: rows and pairs of states read them."""
        from trailmark.operators import rerank
        return self._lists_stage("ctx", name, lambda: rerank.context_candidates(
            self._ranked_rows(name), self.components, self.weights))

    def _candidate_lists(self, name: str) -> DataFrame:
        """Written once: the feature plan reads the lists in two branches
        (rows and state pairs) and would meet the contexts again."""
        from trailmark.operators import rerank
        train = name == "train"
        return self._lists_stage("cand-lists", name, lambda: rerank.candidate_lists(
            self._ranked_rows(name), self.components, self.weights, force_true=train, made=None if train else self._context_candidates(name)))

    def ranked_lists(self, name: str) -> DataFrame:
        """The lists of all rows of the split for learning (J9); a stage table. Evaluation lists come once
        beside their rows; training lists, nearly all with a prior of their own, come with their row."""
        from trailmark.operators import listwise
        if name == "train":
            made = self._lists_stage("ranked", name, lambda: listwise.row_lists(self._ranked_rows(name), self.components, self.weights))
            return listwise.with_terms(made, self.terms)
        return self._lists_stage("ranked", name, lambda: listwise.context_lists(
            self._ranked_rows(name), self.components, self._context_candidates(name), self.state_embeddings))

    @cached_property
    def terms(self):
        from trailmark.operators import ensemble, listwise
        return listwise.Terms(ensemble.Arrays(self.components, self.weights), self.components, self.state_embeddings)
