import numpy as np

from tickloom.llm import packing


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def wanted(tokenizer, text):
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_new_tokens_are_encoded_together_and_once(monkeypatch):
    rng = np.random.default_rng(4)
    path = packing.default_vocabulary()
    known = packing.Words(path)
    counted = known.tokenizer = Counted(known.tokenizer)
    monkeypatch.setattr(packing, "words", lambda _: known)
    new = ["".join(rng.choice(list("abcdeéñü"), 9)) for _ in range(3000)]
    texts = [" ".join(new), ", ".join(w.title() for w in new) + ".", "\n".join(w.upper() + "!" for w in new)]
    got = [x for t in texts for x in packing.encode([t], path)]
    assert got == [wanted(counted.tokenizer, t) for t in texts]
    assert counted.texts <= 10


def test_every_latin_pair_and_forgotten_tokens(monkeypatch):
    path = packing.default_vocabulary()
    known = packing.Words(path)
    monkeypatch.setattr(packing, "words", lambda _: known)
    monkeypatch.setattr(packing, "CACHED", 20)
    monkeypatch.setattr(packing, "GATHERED", 3000)
    letters = [chr(i) for i in range(256)] + ["œ", "İ", "́", "’", "　", "<|endoftext|>"]
    texts = [a + b + "'" + a for a in letters[::3] for b in letters] + [None, "", " "]
    assert packing.encode(texts, path) == [wanted(known.tokenizer, t or "") for t in texts]
    assert len(known) == 20 and len(known.first) == 21
