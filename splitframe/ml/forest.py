"""Boosted trees as flat arrays, by which a batch of rows walks all trees level by level."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..names import quoted

#: Rows and trees that walk at once.
STEPS_AT_ONCE = 1_000_000
MISSING = np.iinfo(np.int32).max


class Forest:
    """feature, bin, left, right and weight of all nodes of all trees; a leaf's children are the leaf itself."""

    def __init__(self, model):
        self.features = list(model.cuts)
        self.cuts = [np.array(c[:-1], float) for c in model.cuts.values()]
        self.rate, self.start, self.classes = model.learning_rate, model.start, model.classes
        number = {f: k for k, f in enumerate(self.features)}
        feature, bin_, left, right, weight, roots = [], [], [], [], [], []
        self.depth = 0
        for tree in model.trees:
            base, place = len(feature), {n: k for k, n in enumerate(sorted(tree))}
            roots.append(base + place[0])
            below = {0: 0}
            for n in sorted(tree):  # children have higher numbers
                here = tree[n]
                split = isinstance(here, tuple)
                feature.append(number[here[0]] if split else 0)
                bin_.append(here[1] if split else 0)
                left.append(base + place[here[2] if split else n])
                right.append(base + place[here[3] if split else n])
                weight.append(0.0 if split else float(here))
                if split:
                    below[here[2]] = below[here[3]] = below[n] + 1
            self.depth = max(self.depth, max(below.values()))
        self.feature, self.bin, self.left, self.right = (np.array(x, np.int32) for x in (feature, bin_, left, right))
        self.weight, self.roots = np.array(weight, float), np.array(roots, np.int32)

    def bins(self, columns: list[np.ndarray], missing: list[np.ndarray]) -> np.ndarray:
        """Bin numbers of rows and features; missing values are above all bins, so they go right."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.int32)
        for k, (x, gone) in enumerate(zip(columns, missing)):
            out[:, k] = np.where(gone, MISSING, np.searchsorted(self.cuts[k], x, side="left"))
        return out

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """Raw scores by row and class."""
        out = np.full((len(bins), self.classes), self.start)
        if not len(self.roots):
            return out
        step = max(1, STEPS_AT_ONCE // len(self.roots))
        for low in range(0, len(bins), step):
            own = bins[low : low + step]
            at = np.broadcast_to(self.roots, (len(own), len(self.roots))).copy()
            line = np.arange(len(own))[:, None]
            for _ in range(self.depth):
                at = np.where(own[line, self.feature[at]] <= self.bin[at], self.left[at], self.right[at])
            for k in range(self.classes):
                out[low : low + step, k] += self.rate * self.weight[at[:, k :: self.classes]].sum(1)
        return out

    def raw(self) -> Column:
        """An array of the raw scores of a row with the model's features."""
        import pyarrow as pa

        def scored(*columns):
            values = [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
            found = self.walk(self.bins(values, [c.is_null().to_numpy(zero_copy_only=False) for c in columns]))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * self.classes, pa.int32()), pa.array(found.ravel()))

        return F.arrow_udf(scored, "array<double>", ArrowUDFType.SCALAR)(*[F.col(quoted(f)).cast("double") for f in self.features])
