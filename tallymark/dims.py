"""Small constant tables: label scale, lessons, models, drawing functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: these must equal the values the rubric data uses. --------

VALID_LABELS = ["Extensive Evidence", "Convincing Evidence", "Limited Evidence", "No Evidence"]
PASSING_LABELS = ["Extensive Evidence", "Convincing Evidence"]

SUPPORTED_MODELS = [
    "bedrock.anthropic.claude-v2",
    "bedrock.anthropic.claude-3-sonnet-20240229-v1:0",
    "bedrock.anthropic.claude-3-5-sonnet-20240620-v1:0",
    "bedrock.us.anthropic.claude-sonnet-4-5-20250929-v1:0",
    "bedrock.meta.llama2-13b-chat-v1",
    "bedrock.meta.llama2-70b-chat-v1",
    "gpt-3.5-turbo-0125",
    "gpt-4-0314",
    "gpt-4-32k-0314",
    "gpt-4-0613",
    "gpt-4-32k-0613",
    "gpt-4-1106-preview",
    "gpt-4-0125-preview",
    "gpt-4-turbo-2024-04-09",
]
DEFAULT_MODEL = "bedrock.us.anthropic.claude-sonnet-4-5-20250929-v1:0"

LESSONS = [
    "csd3-2023-L7",
    "csd3-2023-L11",
    "csd3-2023-L14",
    "csd3-2023-L18",
    "csd3-2023-L21",
    "csd3-2023-L24",
    "csd3-2023-L28",
]

REQUIRED_PARAMS = ["model", "num-responses", "temperature"]
ALLOWED_PARAMS = [
    "model",
    "num-responses",
    "temperature",
    "remove-comments",
    "num-passing-grades",
    "response-type",
    "lesson",
    "code-feature-extractor",
]
DEPRECATED_PARAMS = ["num-passing-grades"]
RESPONSE_TYPES = ["json", "tsv"]

REQUIRED_COLUMNS = ["Key Concept", "Observations", "Label", "Reason"]

# Argument names of the drawing functions.
FUNCTION_ARGS = {
    "arc": ["x", "y", "w", "h", "start", "stop"],
    "background": ["color"],
    "createSprite": ["x", "y", "w", "h"],
    "ellipse": ["x", "y", "w", "h"],
    "fill": ["color"],
    "line": ["x1", "y1", "x2", "y2"],
    "point": ["x", "y"],
    "rect": ["x", "y", "w", "h"],
    "regularPolygon": ["x", "y", "sides", "size"],
    "rgb": ["r", "g", "b", "a"],
    "text": ["str", "x", "y", "width", "height"],
}
SHAPE_FUNCTIONS = ["circle", "ellipse", "quad", "rect", "regularPolygon", "shape", "triangle"]
COUNTED_SHAPES = ["rect", "ellipse", "line", "arc", "point", "regularPolygon", "shape"]
SPRITE_METHODS = ["setAnimation"]
MOVEMENT_PROPERTIES = ["x", "y", "velocityX", "velocityY", "rotation"]
USER_INTERACTION_FUNCTIONS = [
    "keyDown",
    "keyWentDown",
    "keyWentUp",
    "mouseDidMove",
    "mouseDown",
    "mouseIsOver",
    "mousePressedOver",
    "mouseWentDown",
    "mouseWentUp",
]

# ---- End of fixed values. ---------------------------------------------------

PASS_CLASS = "/".join(PASSING_LABELS)
FAIL_CLASS = "/".join(label for label in VALID_LABELS if label not in PASSING_LABELS)
PASS_FAIL_CLASSES = [PASS_CLASS, FAIL_CLASS]

PASS_FAIL = "pass_fail"
EXACT = "exact"

# One evaluation run; every canonical table carries these columns.
RUN_KEY = ["dataset", "experiment", "lesson"]
STUDENT_KEY = RUN_KEY + ["student_id"]


def lit_array(values: list[str]) -> Column:
    """A constant ARRAY<STRING> column."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def label_ord(label: Column) -> Column:
    """0..3 for a label of the scale, NULL for anything else."""
    return F.nullif(F.array_position(lit_array(VALID_LABELS), label), F.lit(0)) - 1


def label_dim(spark):
    """The four-row label table: label, ord, passing."""
    return spark.createDataFrame(
        [(label, i, label in PASSING_LABELS) for i, label in enumerate(VALID_LABELS)],
        "label string, ord int, passing boolean",
    )
