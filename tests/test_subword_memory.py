"""What a worker holds to mark sub-words is bounded by characters, whatever a batch brings."""

from loreloom.functions import subword


def test_lists_are_bounded_by_characters():
    texts = ["abc", None, "", "x" * 10, "de", "fgh"]
    parts = list(subword.bounded(texts, 5))
    assert [t for part in parts for t in part] == texts
    assert parts == [["abc", None, ""], ["x" * 10], ["de", "fgh"]]


def test_lattices_and_memory_are_bounded(monkeypatch):
    monkeypatch.setattr(subword, "REMEMBERED", 200)
    monkeypatch.setattr(subword, "LEARNED_AT_ONCE", 50)
    costs = {"▁": 5, "a": 5, "b": 5, "ab": 3, "▁ab": 1}
    small, walked = subword.Marker(costs).prepare(), []
    learn = small.learn
    monkeypatch.setattr(small, "learn", lambda words: (walked.append(sum(map(len, words))), learn(words)))
    texts = [" ".join("ab" * (i % 7 + 1) + "c" * i for i in range(n, n + 6)) for n in range(20)]
    large = subword.Marker(costs).prepare()
    assert [small.mark([t])[0] for t in texts] == large.mark(texts)
    assert max(walked) <= 50 and sum(map(len, small.new)) <= 200 + max(map(len, texts))
