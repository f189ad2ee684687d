"""What grew faster than its input, or took too long."""

import random

import pytest

from loomery.llm import simhash, token_store
from loomery.llm.queries import tokenizer_path


@pytest.mark.parametrize("rounds", [(4, 12), ()])
def test_near_copies_give_few_links(spark, monkeypatch, rounds):
    """A group of near copies meets in every list; its links do not grow with lists times members, and its class stays whole."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(80))) for i in range(60)]
    for i in range(400):
        words = list(base)
        words[rng.randrange(300)] = f"other{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    made, stage = {}, simhash.stage_table

    def seen(df, name):
        out = stage(df, name)
        made[name] = made.get(name, 0) + (out.where("a is not null").count() if name == "links" else 0)
        return out

    monkeypatch.setattr(simhash, "stage_table", seen)
    got = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string"), sketch=simhash.SIMILAR).collect()}
    assert got == {i: 0 for i in range(400)} | {i: i for i in range(1000, 1060)}
    if rounds:
        assert made["links"] < 400 * 2


def test_one_node_is_not_compared_with_itself(monkeypatch):
    """Members of one component are one node: they give no link, and what links with any of them joins all."""
    fp = simhash.np.array([[0] * 8, [0] * 7 + [255], [0] * 7 + [240], [9] * 8], "u1")
    out = simhash.forest(fp, simhash.np.array([5, 5, 7, 8]))
    assert [(a.tolist(), b.tolist()) for a, b in out] == [([5], [7])]


def test_frequent_words_are_encoded_once(monkeypatch):
    """Words that come again and again stay known while others pass through a small memory."""
    monkeypatch.setattr(token_store, "CACHE_BYTES", 100_000)
    enc = token_store.Encoder(tokenizer_path(), 2)
    often, asked, encoded = [f"w{k}x h\u00e9l{'lo' * (k % 5)}" for k in range(100)], [], enc._encoded

    def seen(words):
        words = [*words]
        asked.extend(words)
        return encoded(words)

    monkeypatch.setattr(enc, "_encoded", seen)
    for n in range(60):
        texts = [" ".join(often), " ".join(f"rare{chr(97 + k % 26)}{n}q{k}" for k in range(60))]
        assert [enc.encode_all(texts)[k] for k in (0, 1)] == [enc.whole(t) for t in texts]
    assert sum(" " + "h\u00e9llo" == w for w in asked) == 1 and sum(w == " w" for w in asked) == 1
