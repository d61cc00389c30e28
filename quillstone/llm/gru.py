"""A bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

WORD_ROWS, CHAR_ROWS = 8192, 4096
#: windows a word must occur in to get a row of its own
OWN_ROW = 4


def word_row(word: str) -> int:
    return 1 + zlib.crc32(word.encode()) % (WORD_ROWS - 1)


def char_rows(word: str) -> list[int]:
    """Hashed runs of three and four letters, the ends marked."""
    w = f"<{word}>"
    return [1 + zlib.crc32(b"c" + w[i : i + n].encode()) % (CHAR_ROWS - 1) for n in (3, 4) for i in range(max(1, len(w) - n + 1))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _sums(count: int, owner: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows added up by owner: ``count`` rows."""
    out = np.zeros((count, rows.shape[1]), np.float32)
    if len(owner):
        if (np.diff(owner) < 0).any():
            order = np.argsort(owner, kind="stable")
            owner, rows = owner[order], rows[order]
        starts = np.flatnonzero(np.r_[True, np.diff(owner) > 0])
        out[owner[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


class BiGRU:
    """Scores token sequences. Tokens enter as a word row and the mean of their character rows."""

    def __init__(self, dim: int = 20, hidden: int = 20, seed: int = 0):
        r = np.random.default_rng(seed)
        self.dim, self.hidden = dim, hidden

        def init(*shape: int, scale: float | None = None) -> np.ndarray:
            return (r.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

        d2, h = 2 * dim, hidden
        self.p = {"E": init(WORD_ROWS, dim, scale=0.1), "C": init(CHAR_ROWS, dim, scale=0.1)}
        for k in "fb":
            self.p |= {f"W{k}": init(d2, 3 * h), f"U{k}": init(h, 3 * h), f"b{k}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": init(2 * h, h), "a": init(h, 1), "V": init(2 * h, 1), "v": np.zeros(1, np.float32)}
        #: words with a row of their own; all others share row 0 and are told by their letters
        self.known: frozenset[str] = frozenset()
        self.m = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.t = 0

    @classmethod
    def of(cls, weights: dict[str, np.ndarray], known: frozenset[str]) -> "BiGRU":
        """A trained network from its weights, for scoring."""
        net = cls.__new__(cls)
        net.p, net.known = weights, known
        net.dim, net.hidden = weights["E"].shape[1], weights["Uf"].shape[0]
        return net

    # -- tokens ------------------------------------------------------------------------------------------------
    def encode(self, vocab: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows of a vocabulary and its character rows as flat indices with owners."""
        rows = np.array([word_row(w) if w in self.known else 0 for w in vocab], np.int64)
        flat, owner = [], []
        for i, w in enumerate(vocab):
            c = char_rows(w)
            flat += c
            owner += [i] * len(c)
        return rows, np.array(flat, np.int64), np.array(owner, np.int64)

    def vectors(self, rows: np.ndarray, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
        n = len(rows)
        count = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        return np.concatenate([self.p["E"][rows], _sums(n, owner, self.p["C"][flat]) / count], 1).astype(np.float32)

    # -- one direction -----------------------------------------------------------------------------------------
    def _run(self, k: str, xw: np.ndarray, mask: np.ndarray, keep: bool):
        """``xw``: (T, B, 3h) inputs already projected; ``mask``: (T, B)."""
        steps, batch, _ = xw.shape
        h = self.hidden
        u = self.p[f"U{k}"]
        state = np.zeros((batch, h), np.float32)
        out = np.zeros((steps, batch, h), np.float32)
        saved = []
        order = range(steps) if k == "f" else range(steps - 1, -1, -1)
        for t in order:
            hu = state @ u
            z = _sigmoid(xw[t, :, :h] + hu[:, :h])
            r = _sigmoid(xw[t, :, h : 2 * h] + hu[:, h : 2 * h])
            n = np.tanh(xw[t, :, 2 * h :] + r * hu[:, 2 * h :])
            m = mask[t][:, None]
            new = m * ((1 - z) * n + z * state) + (1 - m) * state
            if keep:
                saved.append((t, state, z, r, n, hu[:, 2 * h :], m))
            state = new
            out[t] = state
        return out, saved

    def _back(self, k: str, dout: np.ndarray, saved: list, g: dict) -> np.ndarray:
        steps, batch, h = dout.shape
        u = self.p[f"U{k}"]
        dxw = np.zeros((steps, batch, 3 * h), np.float32)
        carry = np.zeros((batch, h), np.float32)
        for t, prev, z, r, n, hn, m in reversed(saved):
            d = dout[t] + carry
            dn = d * m * (1 - z)
            dz = d * m * (prev - n)
            dprev = d * (m * z + (1 - m))
            dna = dn * (1 - n * n)
            dr = dna * hn
            dza = dz * z * (1 - z)
            dra = dr * r * (1 - r)
            dhu = np.concatenate([dza, dra, dna * r], 1)
            dxw[t] = np.concatenate([dza, dra, dna], 1)
            g[f"U{k}"] += prev.T @ dhu
            carry = dprev + dhu @ u.T
        return dxw

    # -- training ----------------------------------------------------------------------------------------------
    def fit(self, windows: list[list[str]], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 5, batch: int = 128, rate: float = 4e-3, seed: int = 0) -> None:
        vocab = sorted({w for x in windows for w in x}) or ["x"]
        ids = {w: i for i, w in enumerate(vocab)}
        uses: dict[str, int] = {}
        for x in windows:
            for w in set(x):
                uses[w] = uses.get(w, 0) + 1
        self.known = self.known | {w for w, n in uses.items() if n >= OWN_ROW}
        rows, flat, owner = self.encode(vocab)
        count = np.maximum(np.bincount(owner, minlength=len(rows)), 1)[:, None].astype(np.float32)
        seqs = [np.array([ids[w] for w in x], np.int64) for x in windows]
        rng = np.random.default_rng(seed)
        weights = np.ones(len(labels), np.float32) if weights is None else weights.astype(np.float32)
        starts = np.searchsorted(owner, np.arange(len(rows) + 1))
        for epoch in range(epochs):
            lr = rate * (0.5 ** (epoch / max(1, epochs - 1) * 2))
            order = rng.permutation(len(seqs))
            order = order[np.argsort([len(seqs[i]) // 4 for i in order], kind="stable")]
            chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
            for c in rng.permutation(len(chunks)):
                idx = chunks[c]
                longest = max(len(seqs[i]) for i in idx)
                tok = np.zeros((longest, len(idx)), np.int64)
                mask = np.zeros((longest, len(idx)), np.float32)
                for j, i in enumerate(idx):
                    s = seqs[i]
                    tok[: len(s), j] = s
                    mask[: len(s), j] = 1
                used, inv = np.unique(tok, return_inverse=True)
                inv = inv.reshape(tok.shape)
                cf = np.concatenate([flat[starts[i] : starts[i + 1]] for i in used])
                co = np.repeat(np.arange(len(used)), [starts[i + 1] - starts[i] for i in used])
                self._step(rows[used], cf, co, count[used], inv, mask, labels[idx].astype(np.float32), weights[idx], lr)

    def _step(self, rows, cf, co, count, inv, mask, y, w, lr) -> None:
        p, h = self.p, self.hidden
        vec = np.concatenate([p["E"][rows], _sums(len(rows), co, p["C"][cf]) / count], 1)
        x = vec[inv]
        fw, fs = self._run("f", x @ p["Wf"] + p["bf"], mask, True)
        bw, bs = self._run("b", x @ p["Wb"] + p["bb"], mask, True)
        hid = np.concatenate([fw, bw], 2)
        key = np.tanh(hid @ p["A"])
        e = (key @ p["a"])[:, :, 0] + (mask - 1) * 1e4
        alpha = np.exp(e - e.max(0))
        alpha /= alpha.sum(0)
        pooled = (alpha[:, :, None] * hid).sum(0)
        logit = (pooled @ p["V"])[:, 0] + p["v"][0]
        prob = _sigmoid(logit)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in "EC"}
        dlogit = (prob - y) * w / len(y)
        g["v"] += dlogit.sum()
        g["V"] += pooled.T @ dlogit[:, None]
        dpool = dlogit[:, None] * p["V"][:, 0]
        dhid = alpha[:, :, None] * dpool
        dalpha = (hid * dpool).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        dkey = de[:, :, None] * p["a"][:, 0]
        g["a"] += np.einsum("tbh,tb->h", key, de)[:, None]
        dka = dkey * (1 - key * key)
        g["A"] += hid.reshape(-1, 2 * h).T @ dka.reshape(-1, h)
        dhid += dka @ p["A"].T
        dx = np.zeros_like(x)
        for k, d, saved in (("f", dhid[:, :, :h], fs), ("b", dhid[:, :, h:], bs)):
            dxw = self._back(k, np.ascontiguousarray(d), saved, g)
            flat = dxw.reshape(-1, 3 * h)
            g[f"W{k}"] += x.reshape(-1, 2 * self.dim).T @ flat
            g[f"b{k}"] += flat.sum(0)
            dx += dxw @ p[f"W{k}"].T
        dvec = _sums(len(vec), inv.ravel(), dx.reshape(-1, dx.shape[2]))
        # the embeddings: only the rows that occurred move
        self._sparse("E", rows, dvec[:, : self.dim], lr)
        self._sparse("C", cf, (dvec[:, self.dim :] / count)[co], lr)
        self.t += 1
        for k, v in g.items():
            np.clip(v, -1, 1, out=v)
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.s[k] = 0.99 * self.s[k] + 0.01 * v * v
            c1, c2 = 1 - 0.9**self.t, 1 - 0.99**self.t
            p[k] -= lr * (self.m[k] / c1) / (np.sqrt(self.s[k] / c2) + 1e-8)

    def _sparse(self, k: str, rows: np.ndarray, grad: np.ndarray, lr: float) -> None:
        used, inv = np.unique(rows, return_inverse=True)
        total = _sums(len(used), inv.ravel(), grad)
        self.s[k][used] += total * total
        self.p[k][used] -= 5 * lr * total / (np.sqrt(self.s[k][used]) + 1e-6)

    # -- scoring -----------------------------------------------------------------------------------------------
    def score(self, windows: list[list[str]], batch: int = 768) -> np.ndarray:
        """Probability of each window."""
        if not windows:
            return np.zeros(0, np.float32)
        ids: dict[str, int] = {}
        seqs = [[ids.setdefault(w, len(ids)) for w in x] for x in windows]
        vec = self.vectors(*self.encode(list(ids) or ["x"]))
        p = self.p
        xf, xb = vec @ p["Wf"] + p["bf"], vec @ p["Wb"] + p["bb"]
        out = np.zeros(len(seqs), np.float32)
        order = np.argsort([len(s) for s in seqs], kind="stable")
        for at in range(0, len(order), batch):
            idx = order[at : at + batch]
            longest = max(1, len(seqs[idx[-1]]))
            tok = np.zeros((longest, len(idx)), np.int64)
            mask = np.zeros((longest, len(idx)), np.float32)
            for j, i in enumerate(idx):
                s = seqs[i]
                tok[: len(s), j] = s
                mask[: len(s), j] = 1
            fw, _ = self._run("f", xf[tok], mask, False)
            bw, _ = self._run("b", xb[tok], mask, False)
            hid = np.concatenate([fw, bw], 2)
            e = (np.tanh(hid @ p["A"]) @ p["a"])[:, :, 0] + (mask - 1) * 1e4
            alpha = np.exp(e - e.max(0))
            alpha /= alpha.sum(0)
            out[idx] = _sigmoid((((alpha[:, :, None] * hid).sum(0)) @ p["V"])[:, 0] + p["v"][0])
        return out
