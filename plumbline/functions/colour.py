"""Mean colours of boxes in image files.  Needs Pillow on the executors; without it, give colours as a column."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _means(content: pd.Series, boxes: pd.Series) -> pd.Series:
    from PIL import Image  # optional

    out = []
    for data, items in zip(content, boxes, strict=True):
        image = Image.open(io.BytesIO(data))
        full = image.size
        image.draft("RGB", (full[0] // 8, full[1] // 8))  # an eighth of the size is enough for a mean
        image = image.convert("RGB")
        sx, sy = image.size[0] / full[0], image.size[1] / full[1]
        row = []
        for b in items:
            x, y = min(int(b["x"] * sx), image.size[0] - 1), min(int(b["y"] * sy), image.size[1] - 1)
            crop = image.crop((x, y, max(x + 1, int((b["x"] + b["w"]) * sx)), max(y + 1, int((b["y"] + b["h"]) * sy))))
            row.append([float(v) for v in crop.resize((1, 1), Image.Resampling.BOX).getpixel((0, 0))])
        out.append(row)
    return pd.Series(out)


def mean_colours(content: Column, boxes: Column) -> Column:
    """(r, g, b) of every box of a binaryFile row's image."""
    return F.pandas_udf(_means, "array<array<double>>")(content, boxes)
