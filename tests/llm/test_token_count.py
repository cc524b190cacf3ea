import random

from llm_helpers import corpus, prose

from quern.llm.common import load_tokenizer_path
from quern.llm.token_count import UnigramCounter, sentencepiece_counter, token_counts

PATH = load_tokenizer_path("piece_bpe_32k.model")


def reference(vocabulary, unk, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk, fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def whole_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def test_equals_the_public_tokenizer():
    ref = reference(whole_vocabulary(), 0, True)
    c = sentencepiece_counter(PATH)
    r = random.Random(1)
    texts = [t for _, t in corpus() if t] + [prose(i, 50) for i in range(20)]
    texts += ["".join(chr(r.choice([32, 32, 10, *range(97, 123), 0xE9, 0x4E2D, 0x1F600, 0x2581])) for _ in range(80)) for _ in range(300)]
    texts += [" lead", "trail ", "  two  ", "▁", " ", "a▁b"]
    for t in texts:
        assert c.text(t)[0] == ref(t), repr(t)


def test_ties_and_unknowns_follow_the_tokenizer():
    r = random.Random(2)
    for trial in range(60):
        letters = "abc"
        pieces = {"".join(r.choice(letters) for _ in range(r.randrange(1, 4))) for _ in range(8)} | {"▁a"}
        vocabulary = [("<unk>", 0.0)] + [(p, float(-r.randrange(1, 4))) for p in sorted(pieces)]
        ref = reference(vocabulary, 0, False)
        c = UnigramCounter(vocabulary[1:], byte_fallback=False, least=min(s for _, s in vocabulary))
        for _ in range(20):
            t = "".join(r.choice(letters + " d") for _ in range(12))
            assert c.text(t)[0] == ref(t), (vocabulary, t)


def test_best_score_is_the_maximum():
    vocabulary = [("▁", -1.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -2.2), ("ba", -2.9)]
    score = dict(vocabulary)
    c = UnigramCounter(vocabulary)

    def best(x):
        if not x:
            return 0.0
        return max(score[x[:k]] + best(x[k:]) for k in range(1, len(x) + 1) if x[:k] in score)

    for t in ("ab", "aba", "abba", "baab", "bababa"):
        assert abs(c.segment("▁" + t)[1] - best("▁" + t)) < 1e-9


def test_query_counts_every_row(docs_of):
    rows = corpus()
    got = sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in token_counts(docs_of(rows)).collect())
    c = sentencepiece_counter(PATH)
    assert got == sorted((str(i), c.text(t)[0], len((t or "").encode())) for i, t in rows)
    assert token_counts(docs_of([])).collect() == []


def test_cache_is_bounded(monkeypatch):
    from quern.llm import token_count

    monkeypatch.setattr(token_count, "CACHE", 5)
    c = UnigramCounter([("▁", -1.0), ("a", -1.0)])
    assert c.text(" ".join("a" * k for k in range(1, 30)))[0] == sum(k + 1 for k in range(1, 30)) and len(c.cache) <= 5


def test_a_text_without_spaces_needs_memory_for_the_longest_piece_only():
    import tracemalloc

    c = sentencepiece_counter(PATH)
    x = "▁" + "".join(random.Random(4).choice("abcdefgh漢é") for _ in range(60_000))
    tracemalloc.start()
    n, _ = c.segment(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 10_000 and peak < 5 << 20
    assert n == reference(whole_vocabulary(), 0, True)(x[1:]) and not c.cache.get(x[1:])


def test_another_vocabulary_may_be_given(docs_of):
    rows = [(1, "ab ab"), (2, None), (2, None), (3, "é"), (None, "ab")]
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts(docs_of(rows), vocabulary=[("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -1.0)]).collect())
    assert got == [("1", 4), ("2", 0), ("2", 0), ("3", 3), ("None", 2)]
