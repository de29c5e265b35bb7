"""LM scoring tells all words of a large vocabulary apart."""

import numpy as np
import pytest

from lexmill.llm import lmscore


@pytest.mark.parametrize("hot", [1, 1_000_000])
def test_every_bigram_has_its_own_count(spark, hot):
    """6,000 words, far more than any fixed number of classes that the model once had; with and without broadcast bigrams."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 6000}" for j in range(30)) for i in range(900)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(0, 900, 2)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.score(d, target, hot).collect()}
    assert len(got) == 900
    words = {w for t in texts for w in t.split()}
    assert len(words) + 1 > lmscore.SIZE

    def model(chosen):
        uni, pair, total, kinds = {}, {}, {}, {}
        for t in chosen:
            s = ["^", *t.split(), "^"]
            for x, y in zip(s, s[1:]):
                uni[y] = uni.get(y, 0) + 1
                kinds[x] = kinds.get(x, 0) + ((x, y) not in pair)
                pair[x, y] = pair.get((x, y), 0) + 1
                total[x] = total.get(x, 0) + 1
        n = sum(uni.values()) + len(words) + 1

        def loss(t):
            s = ["^", *t.split(), "^"]
            out = []
            for x, y in zip(s, s[1:]):
                base = (uni.get(y, 0) + 1) / n
                out.append(-np.log((pair.get((x, y), 0) + kinds[x] * base) / (total[x] + kinds[x]) if x in total else base))
            return np.mean(out)

        return loss

    near, far = model(texts[::2]), model(texts)
    for i in range(0, 900, 37):
        assert got[i].n_tokens == 31
        assert got[i].target_loss == pytest.approx(near(texts[i]), rel=1e-9) and got[i].background_loss == pytest.approx(far(texts[i]), rel=1e-9)


def test_memory_of_a_group():
    """Opening a group of n tokens takes less than 100 n bytes at its highest, and every bigram keeps its count."""
    import tracemalloc

    rng, n = np.random.default_rng(5), 400_000
    words = np.sort(np.concatenate([[lmscore.EDGE], rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)]))
    place = rng.integers(0, len(words), n)
    place[n // 2 - 1] = place[-1] = np.flatnonzero(words == lmscore.EDGE)[0]
    row = {
        "lengths": np.full(2, n // 2, "<i8").tobytes(), "targets": bytes([1, 0]), "n_words": len(words), "n_tokens": n,
        "words": lmscore.squeeze(lmscore.gaps(words)), "sequence": lmscore.squeeze(place.astype("<u2")),
    }
    tracemalloc.start()
    try:
        g = lmscore.Group(row, words[::3].copy(), 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 * n
    before = np.roll(place, 1)
    before[0] = place[-1]
    want, counts = np.unique(before * len(words) + place, return_counts=True)
    assert len(g.n) == len(want) and g.n.sum() == n and sorted(g.n.tolist()) == sorted(counts.tolist())
    assert (g.n[g.back] == counts[np.searchsorted(want, before * len(words) + place)]).all()
