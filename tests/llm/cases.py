"""Documents with nulls, empty and long texts, ties, repeats and columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, node string, size int, row int, __times int, gone int, __gone int, of_id int, of_key int, key int, doc int, stays int, times int, sha256 int, of_sha256 int, rows int"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def rows() -> list[tuple]:
    rng = random.Random(5)
    base = words(rng, 120)
    texts: list[str | None] = [None, "", "   \n\t", "one", "two words", "ONE", "naïve café 日本語 🙂 it's 12,345!!", " ".join(base), " ".join(base), " ".join(base).upper()]
    for k in (1, 2, 3, 5, 8, 12, 20, 40):
        other = list(base)
        for i in rng.sample(range(len(other)), k):
            other[i] = words(rng, 1)[0]
        texts.append(" ".join(other))
    texts.append(" ".join(base[:60] + words(rng, 60)))
    texts.append(" ".join(words(rng, 30_000)))
    texts += [" ".join(words(rng, rng.randint(1, 200))) for _ in range(20)]
    out = [(i, t, "en", None if i % 7 == 0 else f"src{i % 4}", len(t or ""), -i, "x", 1, 2, 3, *range(11)) for i, t in enumerate(texts)]
    return [*out, out[7], (None, "no id", "en", "src1", 5, 0, "x", 1, 2, 3, *range(11))]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
