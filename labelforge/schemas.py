"""Schemas, label lists and hypothesis tables.

A label set is described by a ``LabelSpec``: the label columns in file order
(that order is the order of the packed vector, everywhere) and the hypothesis
sentences used to turn a labelled row into premise/hypothesis pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values of the original corpus for the
# datasets to line up: the label columns in file order, and per label (except
# the first, which has no hypothesis) its index in the vector and its positive
# and negative hypothesis sentence.
# ---------------------------------------------------------------------------
CORPUS_LABELS = [
    "Aggregate",
    "Has Human Subjects",
    "Has Target Disease",
    "Cohort Study or Clinical Trial",
    "Has Quantitative Outcome Measure",
    "Has Study Drug(s)",
    "Has Population Size",
    "Has Comparator Group",
]

CORPUS_HYPOTHESES = [
    # (label name, label index, positive hypothesis, negative hypothesis)
    ("Cohort Study or Clinical Trial", 3,
     "This study has a cohort study or clinical trial",
     "This study does not have any cohorts or clinical trial"),
    ("Has Comparator Group", 7,
     "This study has a control, double-blind, or comparison patient group",
     "This study does not have any comparison patient group"),
    ("Has Human Subjects", 1,
     "This study has human subjects",
     "This study does not have human subjects"),
    ("Has Population Size", 6,
     "This study contains population size or sample size information",
     "This study does not contain population size information"),
    ("Has Quantitative Outcome Measure", 4,
     "This study has quantitative outcomes like numbers, P-value, OR, CI, HR, RR, or patient ratios",
     "This study does not have any quantitative outcomes"),
    ("Has Study Drug(s)", 5,
     "This study has a target drug",
     "This study does not have a target drug"),
    ("Has Target Disease", 2,
     "This study has a target disease",
     "This study does not have a target disease"),
]

SPLIT_VALUES = ["Train", "Validation", "Test"]
MODEL_MAX_LENGTH = 512
NORM_EPS = 1e-8
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Hypothesis:
    label_name: str
    label_idx: int
    positive: str
    negative: str


@dataclass(frozen=True)
class LabelSpec:
    labels: list[str]
    hypotheses: list[Hypothesis] = field(default_factory=list)

    def index_of(self, name: str) -> int:
        return self.labels.index(name)


CORPUS_SPEC = LabelSpec(
    labels=CORPUS_LABELS,
    hypotheses=[Hypothesis(*h) for h in CORPUS_HYPOTHESES],
)

# Stand-in spec over the test tables: labels(quality, toxic) play the label
# columns; both get a hypothesis pair.
TEST_SPEC = LabelSpec(
    labels=["quality", "toxic"],
    hypotheses=[
        Hypothesis("quality", 0, "This text is of good quality",
                   "This text is not of good quality"),
        Hypothesis("toxic", 1, "This text is toxic", "This text is not toxic"),
    ],
)


ABSTRACT_SCHEMA = T.StructType([
    T.StructField("PMID", T.LongType(), False),
    T.StructField("Title", T.StringType(), True),
    T.StructField("Abstract", T.StringType(), True),
])


def label_file_schema(labels: list[str], first_integral: bool = True) -> T.StructType:
    """Schema of a label file: PMID, Split, Number of Annotators, labels.

    The first label column is integral in the corpus files (``Aggregate``);
    the others are doubles.
    """
    fields = [
        T.StructField("PMID", T.LongType(), False),
        T.StructField("Split", T.StringType(), True),
        T.StructField("Number of Annotators", T.LongType(), True),
    ]
    for i, name in enumerate(labels):
        dtype = T.LongType() if (i == 0 and first_integral) else T.DoubleType()
        fields.append(T.StructField(name, dtype, True))
    return T.StructType(fields)


TRIAL_CONFIG_SCHEMA = T.StructType([
    T.StructField("per_device_train_batch_size", T.LongType()),
    T.StructField("per_device_eval_batch_size", T.LongType()),
    T.StructField("num_train_epochs", T.DoubleType()),
    T.StructField("max_steps", T.LongType()),
    T.StructField("weight_decay", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
])

TRIAL_METRICS = [
    "eval_f1_micro", "eval_f1_macro", "eval_precision_micro",
    "eval_precision_macro", "eval_recall_micro", "eval_recall_macro",
    "eval_combined_score",
]

TRIAL_RESULT_SCHEMA = T.StructType(
    [T.StructField("objective", T.DoubleType()),
     T.StructField("eval_loss", T.DoubleType())]
    + [T.StructField(m, T.DoubleType()) for m in TRIAL_METRICS]
    + [T.StructField("eval_runtime", T.DoubleType()),
       T.StructField("eval_samples_per_second", T.DoubleType()),
       T.StructField("eval_steps_per_second", T.DoubleType()),
       T.StructField("epoch", T.DoubleType()),
       T.StructField("time_this_iter_s", T.DoubleType()),
       T.StructField("should_checkpoint", T.BooleanType()),
       T.StructField("done", T.BooleanType()),
       T.StructField("training_iteration", T.LongType()),
       T.StructField("trial_id", T.StringType()),
       T.StructField("date", T.StringType()),
       T.StructField("timestamp", T.LongType()),
       T.StructField("time_total_s", T.DoubleType()),
       T.StructField("pid", T.LongType()),
       T.StructField("hostname", T.StringType()),
       T.StructField("node_ip", T.StringType()),
       T.StructField("config", TRIAL_CONFIG_SCHEMA),
       T.StructField("time_since_restore", T.DoubleType()),
       T.StructField("iterations_since_restore", T.LongType())]
)
