"""Plain versions of the corpus operators, and the rows they are held against."""

import random
import re
import zlib

import numpy as np
import xxhash

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = {"en": "the of and thing other with was from that there house water right small between".split(),
         "de": "der die und nicht eine schön wasser haus zwischen recht klein über straße groß mädchen".split()}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(VOCAB[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(n))


def corpus(seed=7, n=60):
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, odd texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        rows.append((i, prose(rng, rng.choice([3, 20, 120, 400]), lang), lang, "src", 1))
    for i in range(n, n + 15):  # exact copies, some in other letter case
        t = rows[i % 5][1]
        rows.append((i, t.upper() if i % 3 == 0 and t.isascii() else t, rows[i % 5][2], "src", 2))
    base = prose(rng, 3000)
    for i in range(n + 15, n + 30):  # near copies of a long text
        words = base.split(" ")
        words[rng.randrange(3000)] = "changed"
        rows.append((i, " ".join(words), "en", "src", 3))
    odd = [None, "", "   ", "\n\t", "12345 !!", "x", "É", "one two", prose(rng, 40_000), "日本語のテキスト" * 3, "a b c"]
    return rows + [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]


def clash(df):
    """The rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    for name in ("fp", "shard", "size", "score", "tie", "_id", "_t", "_h", "kept", "held_out", "minhash", "part", "ids", "carried", "_doc"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def simhash(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=2):
    """Smallest id reachable, for {id: fingerprint}."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def edit_distance_in(pattern, text):
    """Fewest edits that turn the pattern into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
