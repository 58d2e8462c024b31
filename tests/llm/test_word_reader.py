"""Words as ids, remembered within a bound."""

import numpy as np

from stratalith.llm import language_model as LM


def test_ids_whatever_is_remembered(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [[b"w%d" % i for i in rng.zipf(1.3, 200) % 5000] + [b"x" * 500 + b"%d" % n] for n in range(60)] + [[]]
    plain = [np.array([LM.token_hash(w) for w in t], np.uint64) for t in texts]
    lexicon = np.unique(np.concatenate(plain))[::2]
    place = {h: i for i, h in enumerate(lexicon.tolist())}
    named = [np.array([place.get(h, h | 1 << 63) for h in x.tolist()], np.uint64) for x in plain]
    for most in (0, 2000, 1 << 20):
        monkeypatch.setattr(LM, "_KEPT_BYTES", most)
        for reader, want in ((LM.Reader(), plain), (LM.Reader(lexicon), named)):
            for text, ids in zip(texts, want, strict=True):
                got = reader(text)
                assert got.dtype == np.uint64 and np.array_equal(got, ids)
                # before, texts of many new words could leave twice the bound behind
                assert sum(map(len, reader.known)) <= most
