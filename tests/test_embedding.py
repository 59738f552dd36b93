"""The hashing embedder against plain Python."""

from __future__ import annotations

import hashlib
import math
import re

import pytest

from turnwise.functions.vectors import hashing_embedding


def embed(text, dimensions):
    tokens = [re.sub("(?:ing|ed|es|s|ly)$", "", t) if len(t) > 4 else t for t in re.findall("[a-z0-9]+", (text or "").lower())]
    out = [0.0] * dimensions
    for key, n in [*((t, 2) for t in tokens), *((f"{a}_{b}", 1) for a, b in zip(tokens, tokens[1:]))]:
        out[int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % dimensions] += n
    length = math.sqrt(sum(x * x for x in out))
    return [x / length if length else 0.0 for x in out]


@pytest.mark.parametrize("dimensions", [7, 256])
def test_vectors(spark, dimensions):
    texts = ["Refunds are issued quickly; refund it", "one", "", None, "???", "a a a a", "Wing sing kindly bus"]
    got = {r.i: r.vector for r in hashing_embedding(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i", dimensions=dimensions).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(embed(t, dimensions))
