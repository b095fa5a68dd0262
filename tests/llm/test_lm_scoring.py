"""Word trigram scores against sums over dictionaries."""

import math
from collections import Counter, defaultdict

import pytest

from tests.llm.test_operators import corpus, empty, frame
from thicket.llm import lm_scoring, queries


def plain_losses(texts, vocabulary):
    tri, bi, uni, ctx2, ctx1 = Counter(), Counter(), Counter(), Counter(), Counter()

    def marked(t):
        w = t.split()
        return ["<s>", "<s>", *w, "</s>"] if w else []

    for t in texts:
        w = marked(t)
        for i in range(2, len(w)):
            tri[tuple(w[i - 2 : i + 1])] += 1
            ctx2[tuple(w[i - 2 : i])] += 1
            bi[tuple(w[i - 1 : i + 1])] += 1
            ctx1[w[i - 1]] += 1
            uni[w[i]] += 1
    total, k = sum(uni.values()), lm_scoring.K

    def loss(text):
        w, out = marked(text), 0.0
        for i in range(2, len(w)):
            p1 = (uni[w[i]] + k[2] / vocabulary) / (total + k[2])
            p2 = (bi[tuple(w[i - 1 : i + 1])] + k[1] * p1) / (ctx1[w[i - 1]] + k[1])
            p3 = (tri[tuple(w[i - 2 : i + 1])] + k[0] * p2) / (ctx2[tuple(w[i - 2 : i])] + k[0])
            out -= math.log(p3)
        return out / max(1, len(w) - 2), max(0, len(w) - 2)

    return loss


@pytest.mark.parametrize("size", [8_000_000, 300])
def test_word_scores(spark, monkeypatch, size):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", size)
    rows = corpus(2, 20)
    good = spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 7)] + [(None,)], "doc_id bigint")
    got = lm_scoring.score(frame(spark, rows, extra=True).coalesce(2), good).collect()
    words = {w for _, t, *_ in rows for w in (t or "").split()}
    want = defaultdict(list)
    for at, (k, t, *_) in enumerate(rows):
        # the models of all other rows
        rest = rows[:at] + rows[at + 1 :]
        background = plain_losses([t or "" for _, t, *_ in rest], len(words) + 1)
        target = plain_losses([t or "" for k, t, *_ in rest if k in (1, 2, 3, 7)], len(words) + 1)
        want[k].append((*background(t or ""), target(t or "")[0]))
    assert len(got) == len(rows)
    for r in got:
        assert any(r["n_tokens"] == n and r["background_loss"] == pytest.approx(b, abs=1e-9) and r["target_loss"] == pytest.approx(c, abs=1e-9) for b, n, c in want[r["doc_id"]])
        assert r["difference"] == pytest.approx(r["target_loss"] - r["background_loss"], abs=1e-9)
    assert lm_scoring.score(empty(spark), good).count() == 0


def test_the_query_tells_word_orders_apart(spark, tmp_path):
    """Two texts of the same letter triples, of which one stands in the order of the target's words.  The labelled text
    itself is scored by the others, and no other is labelled."""
    good, other = "aaa bbb aaa ccc aaa ddd aaa", "aaa ddd aaa ccc aaa bbb aaa"
    frame(spark, [(k, t, "en", "x", len(t)) for k, t in enumerate((good, other, good, other))]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["difference"] for r in queries.op5_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[3] > got[2] + 0.01 and got[0] > got[2] + 0.01


def test_hashes_grow_with_the_texts():
    assert [lm_scoring.key_bits(n) for n in (0, 1 << 10, 1 << 30, 1 << 47, 1 << 60)] == [32, 32, 49, 62, 62]
    keys, _, _ = lm_scoring.ngrams(["a b c d"], 40)
    assert (keys & 0xFFFFFC == 0).all() and len(set(keys.ravel().tolist())) == keys.size
