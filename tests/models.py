"""A deterministic text model for tests."""

import numpy as np


def hashed_bag_of_words(dim: int = 64):
    """A deterministic model factory for tests and demos: mean of per-token
    pseudo-random unit vectors seeded by a stable token hash."""
    import xxhash

    def factory():
        cache: dict = {}

        def token_vec(tok: str) -> np.ndarray:
            v = cache.get(tok)
            if v is None:
                rng = np.random.default_rng(xxhash.xxh64_intdigest(tok))
                v = rng.standard_normal(dim).astype(np.float32)
                v /= np.linalg.norm(v) or 1.0
                cache[tok] = v
            return v

        def model(texts):
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                toks = t.lower().split()
                if toks:
                    out[i] = np.mean([token_vec(x) for x in toks], axis=0)
            return out

        return model

    return factory


def _ship():
    """Workers cannot import test modules: send this one's functions whole."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
