"""The secret network on shapes that it wasn't trained on, and on harmless kinds with digits."""

import random
from statistics import mean

from cairn.llm import secret_cnn


def view(text: str, token: str) -> str:
    at = text.index(token)
    return secret_cnn.windows(text, at, at + min(len(token), secret_cnn.BODY))[0]


def test_unseen_shapes():
    """Each shape left out of the training in turn: precision holds for all; recall for all but those that look like ids or words (README)."""
    got = secret_cnn.unseen_shapes()
    assert set(got) == set(secret_cnn.SHAPES)
    assert all(p >= 0.9 for _, p in got.values()), got
    assert mean(r for r, _ in got.values()) >= 0.85 and sum(r >= 0.85 for r, _ in got.values()) >= 9, got


def test_left_out_shapes_are_left_out():
    every, plain = secret_cnn.generated(n=5)
    for k, shape in enumerate(secret_cnn.SHAPES):
        some, same = secret_cnn.generated(n=5, without=shape)
        assert len(some) == len(every) - 5 and len(same) == len(plain), (k, shape)


def test_labels_of_accounts_and_bank_numbers():
    rng = random.Random(1)
    for _ in range(200):
        number = secret_cnn.iban(rng)
        assert secret_cnn.harmless(number, 0, len(number))
        wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
        assert not secret_cnn._IBAN.fullmatch(wrong) or int("".join(str(int(c, 36)) for c in wrong[4:] + wrong[:4])) % 97 != 1
    text = "postgres://admin:hunter2Pass99@db.example.com/x and mail me.too99@example.com"
    spans = {text[s:e]: (s, e) for s, e in secret_cnn.candidates(text, [])}
    assert secret_cnn.account(text, *spans["hunter2Pass99"]) and not secret_cnn.harmless(text, *spans["hunter2Pass99"])
    assert secret_cnn.harmless(text, *spans["me.too99"]) and not secret_cnn.account(text, *spans["me.too99"])


def test_accounts_are_found_and_known_kinds_are_not():
    model = secret_cnn.fit([], [])
    p = model.probability(secret_cnn.codes([view(f"see {s}://app:{w}@db.example.com/x now", w) for s in ("postgres", "amqp") for w in ("hunter2Pass99", "Winter2024x7", "blue42Horse77")]))
    assert (p >= model.threshold).mean() >= 0.8, p
    fresh = random.Random(5).sample(secret_cnn.generated(seed=71, n=100)[1], 400)
    p = model.probability(secret_cnn.codes([view(f"with the words before {t} and some more", t) for t in fresh]))
    assert (p >= model.threshold).mean() <= 0.08
    assert model.report["calibration_error"] <= 0.05 and model.report["recall_without_name"] >= 0.95, model.report


def test_every_labelled_finding_is_trained_on(spark):
    """More findings than a shard holds: none is left out, and shards that begin with the same weights give one network."""
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(24))
    texts = [f"the token = {key()} of box {i} is for anna.miller{i}@mail.example.com" for i in range(1300)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts, None, ""]], "text string")
    rows = secret_cnn.labelled(docs).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in rows} == {1: 1300, 0: 1300}
    model, alone = secret_cnn.train(docs), secret_cnn.fit([], [])
    assert model.report["tested"] > 2 * alone.report["tested"] and model.report["recall_without_name"] >= 0.95 and model.report["precision_without_name"] >= 0.95, model.report
