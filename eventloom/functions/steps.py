"""Values that Python makes of a column of texts, as Arrow."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters whose values are Python objects at a time.
STEP = 1 << 18


def in_steps(source: pa.Array, make: Callable[[str | None], dict], kind: T.StructType) -> pa.Array:
    """What `make` gives of each text. A batch is of thousands of texts, whose values as Python objects take many times what they take
    as Arrow; so they become Arrow step by step."""
    arrow, done, step, size = to_arrow_type(kind), [], [], 0
    for text in source:
        text = text.as_py()
        step.append(make(text))
        size += len(text or "")
        if size >= STEP:
            done.append(pa.array(step, arrow))
            step, size = [], 0
    return pa.concat_arrays([*done, pa.array(step, arrow)])
