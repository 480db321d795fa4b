import zlib

import numpy as np

from laneatlas.llm.quality import QualityModel, choose, fit_quality, remainder, score_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels)
    rows = score_quality(docs, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality", (remainder() == 0).alias("held_out")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out]
    good, bad = [r.predicted for r in out if r.quality == 1], [r.predicted for r in out if r.quality == 0]
    assert np.mean(good) > 0.95 and (not bad or np.mean(bad) < 0.35)


def test_only_training_rows_are_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", f"if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    a, b = fit_quality(docs, labels), fit_quality(docs, flipped)
    assert a.good == b.good and a.bad == b.bad and (a.weights == b.weights).all()


def test_bounds(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    small = fit_quality(docs.selectExpr("*", "5 as quality", "'x' as score"), labels, max_per_class=10, max_bytes=20_000)
    assert 0 <= small.score(["some text"])[0] <= 1


def test_edges(spark, edges):
    df = spark.createDataFrame([(*r, 9) for r in edges], "doc_id long, text string, label int")
    for model in (QualityModel.fit([], []), QualityModel.fit(["only good"], [1]), QualityModel.fit(["good words here", "BAD!! BAD!!"] * 5, [1, 0] * 5)):
        rows = score_quality(df, model).collect()
        assert len(rows) == len(edges) and all(0 <= r.score <= 1 for r in rows)
    assert model.score([None])[0] == model.score([""])[0]
    assert score_quality(df.limit(0), model).count() == 0
    empty = fit_quality(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.score(["x"])[0] > 0.3


def test_class_ratio_does_not_depend_on_the_cap(spark):
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "the same plain words in every text " * 20) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k % 7 > 0), 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    share = np.mean([k % 7 > 0 for k in range(len(ids))])
    for cap in (2000, 40):  # texts without evidence score the share of label 1
        assert abs(fit_quality(docs, labels, max_per_class=cap).score(["the same plain words in every text " * 20])[0] - share) < 0.02


def test_bytes_are_given_out_by_rank_and_class():
    r = np.random.default_rng(1)
    held = [(int(k % 3 > 0), (int(r.integers(1 << 40)), k), 1, int(r.integers(1, 200))) for k in range(300)] + [(1, (-1, 300), 1, 10**6)]
    got = choose(held, 5000)
    size = {h[1]: h[3] for h in held}
    assert sum(size[k] for _, k, _ in got) <= 5000 and all(cut == -1 for *_, cut in got)
    n = [sum(y == c for y, *_ in got) for c in (0, 1)]
    assert abs(n[0] - n[1]) <= 8 and sum(n) > 40
    assert choose([(0, (1, 1), 1, 10), (1, (2, 2), 2, 10**6)], 800) == [(0, (1, 1), -1), (1, (2, 2), 50)]


def test_one_huge_text_does_not_end_the_sample(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    text = lambda k: ("calm clear words about rivers " if k % 2 else "BUY!!! $$$ win NOW ") * 8
    docs = spark.createDataFrame([(i, "x" * 300_000 if k == 0 else text(k)) for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    good, bad = fit_quality(docs, labels, max_bytes=100_000).score([text(1), text(2)])
    assert good > 0.5 > bad
    huge = fit_quality(docs.selectExpr("doc_id", "repeat(text, 1000) as text"), labels, max_bytes=1000)
    assert len(set(huge.score([text(1), text(2)]))) == 2


def test_scores_against_loops(corpus):
    """The same scores from plain formulas, a text and a window at a time."""
    import math

    import zstandard

    from laneatlas.llm.quality import QualityModel

    texts = list(corpus.values())
    model = QualityModel.fit(texts, [k % 3 != 0 for k in range(len(texts))])
    made = []
    for dictionary in (model.good, model.bad):
        data = zstandard.ZstdCompressionDict(dictionary)
        made.append(zstandard.ZstdCompressor(level=1, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
    some = [*texts[:40], "", None]
    c = model.curve
    for text, score in zip(some, model.score(some)):
        b = (text or "").encode()
        x = []
        for span in (64, 256, 1024, 1 << 20):
            parts = [b[i : i + span] for i in range(0, len(b), span)] or [b""]
            g, w = ([len(m.compress(p)) - 8 for p in parts] for m in made)
            gs, ws = max(1, sum(g)), max(1, sum(w))
            x += [(ws - gs) / max(1, len(b)), (ws - gs) / (ws + gs)]
            if span <= 256:
                d = sorted((w[k] - g[k]) / max(16, len(p)) for k, p in enumerate(parts))
                cut = (len(d) - 1) // 10
                x += [d[cut], d[-1 - cut], sum(v < 0 for v in d) / len(d), sum(v == 0 for v in d) / len(d)]
        z = [min(4, max(-4, (v - m) / s)) for v, m, s in zip(x, c.mean, c.spread)]
        terms = [1.0, *z, *[max(0, v - e) for bend in c.bends for v, e in zip(z, bend)]]
        terms += [z[i] * z[j] for i in range(16) for j in range(i, 16)] + [math.tanh(z[i] - z[j]) for i in range(16) for j in range(i + 1, 16)]
        u = sum(a * t for a, t in zip(c.weights, terms, strict=True))
        assert abs(score - 1 / (1 + math.exp(-min(30, max(-30, u))))) < 1e-6


def test_fit_finds_the_least_loss():
    """No small change of a weight lowers the penalised loss."""
    from laneatlas.llm.quality import fit_logistic

    r = np.random.default_rng(2)
    x = np.concatenate([np.ones((80, 1)), r.normal(size=(80, 4))], axis=1)
    y = (x[:, 1] + 0.5 * r.normal(size=80) > 0).astype(float)
    w = fit_logistic(x, y, 0.1)

    def loss(w):
        z = x @ w
        return sum(math_log1p(-v if t else v) for v, t in zip(z, y)) + 0.05 * (w[1:] @ w[1:]) + 0.5e-6 * w[0] ** 2

    def math_log1p(v):
        return np.log1p(np.exp(v))

    for k in range(5):
        for d in (-1e-3, 1e-3):
            other = w.copy()
            other[k] += d
            assert loss(other) >= loss(w) - 1e-12


def test_difference_alone_ranks_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = score_quality(docs.join(labels.where("quality is not null"), "doc_id"), fit_quality(docs, labels)).where(remainder() == 0).select("score", "quality").collect()
    good, bad = np.sort([r.score for r in rows if r.quality == 1]), np.array([r.score for r in rows if r.quality == 0])
    auc = (np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")).sum() / 2 / len(good) / len(bad)
    assert 1 - auc > 0.99
