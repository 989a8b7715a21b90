"""The memory of token ids in a worker."""

from corvane.llm import tokens


def test_pieces_are_made_when_asked_for_and_kept_for_a_generation(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 2)
    made = []
    memory = tokens.Memory(lambda p: made.append(p) or p.encode())
    assert b"".join(map(memory.__getitem__, ["a", "b", "a", "c"])) == b"abac" and made == ["a", "b", "c"]
    memory.turn()
    assert memory["b"] == b"b" and made == ["a", "b", "c"] and list(memory) == ["b"]
    for p in "def":
        assert memory[p] == p.encode()
    memory.turn()
    assert memory["a"] == b"a" and made == [*"abcdef", "a"]


def test_batches_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    enc = tokens.Encoder(tokens.default_vocabulary())
    texts = ["Don't I'LL, 12.5-3 (a) [b]!! x''y 'tis", "", "..", "a,b. c", "Straße 3,4 中文", "one one two"]
    for _ in range(2):
        assert [enc.batch([t]) for t in texts] == [enc._encode([t]) for t in texts] and enc.batch(texts) == enc._encode(texts)
