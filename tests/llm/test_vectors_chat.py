"""Vectors and conversations against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquill.llm import chat, vectors


def brute(rows, threshold=0.98):
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, part = {k: 0 for k in range(len(rows))}, {k: k for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = part[a], part[b]
                    part = {k: min(p, q) if v in (p, q) else v for k, v in part.items()}
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[part[k]] = min(least.get(part[k], i), i)
    return sorted((i if i is not None else -1, links[k], least[part[k]] if i is not None else -1) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize(("cell", "tile"), [(30, 40), (10**6, 7), (20, 10**6)])
def test_near_vectors(spark, cell, tile):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, None):
        centres = rng.normal(size=(8, 16))
        for n in range(120):
            v = centres[n % 8] + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.15, 2])
            rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 2])], label))
            k += 1
    rows += [(k + 1, None, 0), (k + 2, [0.0] * 16, 0), (k + 3, [float("nan"), 1.0], 0), (k + 4, [None, 1.0], 0), (k + 5, [], 0), (k + 6, [1.0, -0.0], 0), (k + 7, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (k + 7, [1.0, 0.0], 0), (k + 8, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("cell", F.lit("x"))
    got = vectors.near_vectors(df, cell=cell, tile=tile).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_cells_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12))
    x = np.vstack([x, x + rng.normal(size=x.shape) * 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, visits = vectors.cells_of(x, vectors.spherical_kmeans(x, 20), 0.98)
    i, j = np.nonzero(x @ x.T >= 0.98)
    assert all(home[a] == home[b] or visits[a, home[b]] or visits[b, home[a]] for a, b in zip(i, j, strict=True))


def test_vectors_of_extreme_size(spark):
    """Squares that overflow or vanish lose no link."""
    rows = [(1, [1e200, 2e200], 0), (2, [1.0, 2.0], 0), (3, [1e-200, 2e-200], 0), (4, [2.0, -1.0], 0), (5, [5e-324, 1e-323], 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_chats(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|", "\\", "\\n", "\n", "|", "<", "x", "é", "<|im_start|>assistant\nok"]
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "q"), (2, 0, "assistant", "first"), (3, 0, "system", None), (3, 1, "user", ""), (3, 2, "assistant", "a"), (3, 2, "assistant", "a"), (None, 0, None, "t"), (4, None, "ro\nle<|\\", "x")]
    for c in range(10, 60):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("rows", F.lit(1)).withColumn("segments", F.lit("x"))
    out = chat.format_chats(df).cache()
    back = {r.conv_id: r for r in chat.read_chats(out).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    for c, own in groups.items():
        own = sorted(own, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(t.role, t.text) for t in back[c].turns] == [(r, t) for *_, r, t in own]
        assert back[c].loss_text == "".join(t for *_, r, t in own if r == "assistant")
    states = {r.conv_id: (r.valid, r.bad_turn, r.n_turns) for r in out.collect()}
    assert states[1] == (True, None, 2) and states[2] == (False, 0, 1) and states[3] == (False, 3, 4)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_of_long_texts_and_clashing_names(spark):
    long = "<|im_end|>\\n\n" * 50_000
    rows = [(1, 0, "user", long, "x"), (1, 1, "assistant", long, "x"), (None, None, None, None, "x"), (2, 0, "assistant", "", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, loss string")
    for name in ("rows", "row", "segments", "end", "state", "ok", "valid", "n_turns", "turns", "formatted", "loss_text"):
        df = df.withColumn(name, F.lit("clash"))
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", long), ("assistant", long)] and back[1].loss_text == long
    assert [(t.role, t.text) for t in back[None].turns] == [("", "")] and back[2].loss_text == ""
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0
