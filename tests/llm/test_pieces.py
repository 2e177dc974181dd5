import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from veldspar.llm import pieces


def slow_segment(vocabulary, word):
    """Best sum of scores by trying every piece at every place; ties: the longest last piece."""
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        char = word[end - 1]
        now = (best[end - 1][0] + vocabulary.unknown * len(char.encode()), best[end - 1][1] + [vocabulary.byte_ids[b] for b in char.encode()])
        for start in reversed(range(end)):
            found = vocabulary.ids.get(word[start:end])
            if found and best[start][0] + found[1] >= now[0]:
                now = (best[start][0] + found[1], best[start][1] + [found[0]])
        best.append(now)
    return best[-1][1]


def unpack(ids):
    return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]


def toy():
    made = [(p, s) for s, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab", "cc", "ca"])]
    made = [(p, -float((n * 7) % 5)) for n, (p, _) in enumerate(made)]
    spelled = [p.replace("▁", " ").encode() for p, _ in made] + [bytes([i]) for i in range(256)]
    return pieces.Vocabulary(made, list(range(len(made), len(made) + 256)), spelled)


def test_shared_prefixes_give_the_plain_viterbi():
    rng = random.Random(1)
    vocabulary = toy()
    words = {" " * rng.randint(0, 1) + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(800)}
    got = vocabulary.segment(list(words))
    assert {w: unpack(i) for w, i in got.items()} == {w: slow_segment(vocabulary, w) for w in words}


def test_public_vocabulary():
    vocabulary = pieces.load()
    words = [" the", " there", " therefore", "straße", " naïve", "xyzzyx", " 日本語", "▁", " ▁a"]
    got = vocabulary.segment(words)
    for w in words:
        assert unpack(got[w]) == slow_segment(vocabulary, w)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = "The quick brown fox, naïve  déjà vu.\n日本 😀"
    assert model.decode(unpack(vocabulary.encode([text])[0])) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_round_trip(text):
    vocabulary = pieces.load()
    assert vocabulary.decode(vocabulary.encode([text])[0]) == text


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 10)
    vocabulary = toy()
    for i in range(5):
        texts = [f"a{i} b{i} c{i} a b c"]
        assert vocabulary.decode(vocabulary.encode(texts)[0]) == texts[0]
        assert len(vocabulary.words) <= 12


def test_columns_and_odd_rows(spark):
    df = documents(spark, ODD).withColumn("ids", F.lit(1))
    out = pieces.encode(df)
    assert out.columns == [*df.columns, "piece_ids"]
    back = pieces.decode(out, into="again").collect()
    assert all(r.again == r.text for r in back) and len(back) == len(ODD)
    rows = pieces.digests(df).collect()
    assert all(r.exact for r in rows if r.n_pieces is not None) and sum(r.n_pieces is None for r in rows) == 2
    assert pieces.digests(documents(spark, [])).count() == 0 and pieces.encode(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", " \n a  b"])
def test_blanks(text):
    vocabulary = pieces.load()
    assert vocabulary.decode(vocabulary.encode([text])[0]) == text
