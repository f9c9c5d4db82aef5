"""The classifier's forward pass against plain loops, its gradients against finite differences, and held-out figures."""

import numpy as np
import pytest

from seatwise.llm import toxicity

SF = "/root/testdata/sf0.01"


def small_net(seed, languages=("a", "b")):
    shape = toxicity.Shape(buckets=50, dim=4, widths=(1, 2, 3), filters=3)
    net = toxicity.ConvNet(shape, list(languages), seed)
    rng = np.random.default_rng(seed)
    for x in (net.head, net.bias, net.head_bias):
        x += rng.normal(0, 0.5, x.shape).astype(np.float32)
    return net, rng


def plain(net, words):
    """Logits of one text by plain loops: sums of embeddings, every filter at every place with two empty words around, maxima."""
    pad = net.pad
    empty = np.zeros(net.shape.dim)
    x = [empty] * pad + [net.embed[w].astype(float).sum(0) for w in words] + [empty] * pad
    top = []
    for w, c in zip(net.shape.widths, net.conv, strict=True):
        for k in range(net.shape.filters):
            top.append(max(sum(float(x[p + o] @ c[o, :, k]) for o in range(w)) for p in range(len(words) + pad)))
    act = np.maximum(np.array(top) + net.bias, 0)
    return act @ net.head + net.head_bias


@pytest.mark.parametrize("seed", range(4))
def test_forward_pass_is_the_plain_convolution(seed):
    net, rng = small_net(seed)
    texts = [rng.integers(0, 50, (n, len(toxicity.PREFIXES))).astype(np.int32) for n in (0, 1, 2, 7, 30, 0, 3)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    for limit in (4, 1 << 16):
        logit, guess = net.logits(np.concatenate(texts), first, limit=limit)
        for k, x in enumerate(texts):
            want = plain(net, x)
            assert logit[k] == pytest.approx(want[0], abs=1e-4) and guess[k] == want[1:].argmax()


def loss(net, texts, toxic, weight, language):
    total = 0.0
    for x, t, w, lang in zip(texts, toxic, weight, language, strict=True):
        out = plain(net, x)
        p = 1 / (1 + np.exp(-out[0]))
        total -= w * (t * np.log(p) + (1 - t) * np.log(1 - p))
        if lang >= 0:
            e = np.exp(out[1:] - out[1:].max())
            total -= 0.3 * np.log(e[lang] / e.sum())
    return total / len(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_step_of_training_follows_finite_differences(seed, monkeypatch):
    net, rng = small_net(seed)
    texts = [rng.integers(0, 50, (n, len(toxicity.PREFIXES))).astype(np.int32) for n in (5, 3, 8, 6)]
    toxic, language = np.array([1, 0, 1, 0]), np.array([0, 1, -1, 0])
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (4 - toxic.sum())) * 4
    monkeypatch.setattr(net, "_begin", lambda *a: None)

    class Rng:  # no text is held out, and their order stays
        def random(self, n):
            return np.ones(n)

        def shuffle(self, x):
            return None

    monkeypatch.setattr(np.random, "default_rng", lambda *a: Rng())
    params = {"head": net.head, "head_bias": net.head_bias, "bias": net.bias, "embed": net.embed, **{f"conv{k}": c for k, c in enumerate(net.conv)}}
    before = {k: v.copy() for k, v in params.items()}
    slopes = {}
    for name, x in params.items():
        flat, found = x.reshape(-1), {}
        for i in np.linspace(0, (len(flat) - net.shape.dim if name == "embed" else len(flat)) - 1, 60).astype(int):  # the pad's row isn't learned
            kept, h = flat[i], 2e-3
            flat[i] = kept + h
            up = loss(net, texts, toxic, weight, language)
            flat[i] = kept - h
            down = loss(net, texts, toxic, weight, language)
            flat[i] = kept
            here = loss(net, texts, toxic, weight, language)
            if abs((up - here) - (here - down)) < 0.05 * abs(up - down) + 1e-7:  # not where a maximum or the rectifier turns
                found[i] = (up - down) / (2 * h)
        slopes[name] = found
    net.fit((np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])), toxic, language, epochs=1, batch=4, rate=1e-3)
    checked = 0
    for name, found in slopes.items():
        moved = (params[name] - before[name]).reshape(-1)
        for i, g in found.items():
            if abs(g) > 0.01:  # Adagrad's first step from a start of 1e-3
                want = -1e-3 * g / np.sqrt(1e-3 + g * g)
                assert moved[i] == pytest.approx(want, rel=0.15, abs=2e-5), (name, i)
                checked += 1
            elif abs(g) < 1e-6:
                assert abs(moved[i]) < 1e-4, (name, i)
    assert checked > 30


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    marked = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null").collect()}
    rows = [(r["score"], marked[r["doc_id"]]) for r in toxicity.toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in marked]
    yes, no = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert len(yes) > 5 and len(no) > 50
    roc = np.mean([(y > n) + 0.5 * (y == n) for y in yes for n in no])
    assert roc > 0.97
    assert np.mean([s >= 0.5 for s in yes]) > 0.8 and np.mean([s < 0.5 for s in no]) > 0.9


def test_score_keeps_null_ids_and_carried_columns(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(None, "a b", "en", "x", 3), (5, None, None, "y", None), (5, "", "en", "z", 1)], "doc_id long, text string, lang string, text_hash string, row long")
    net = toxicity.train(docs, labels)
    out = toxicity.score(docs, net, ("text_hash", "row", "text"))
    assert sorted((r["doc_id"] or 0, r["held_out"], r["text_hash"], r["row"] or 0, r["text"] or "") for r in out.collect()) == [
        (0, None, "x", 3, "a b"), (5, out.where("doc_id = 5").first()["held_out"], "y", 0, ""), (5, out.where("doc_id = 5").first()["held_out"], "z", 1, "")]
