"""Results by definition, without the operators' code."""

import collections
import math
import re
import zlib

import numpy as np


def brute_sets(texts):
    """Each text's shingles with their occurrences, and the weight of each shingle, by the definition alone."""
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", (t or "").lower()) if x]
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))))
    n = sum(map(bool, sets))
    df = collections.Counter(s for x in sets for s in x)
    return sets, {s: round(1024 * (1 + 0.2 * min(1, max(0, math.log(n / k) / math.log(128))))) / 1024 for s, k in df.items()}


def brute_similarity(a, b, weight):
    return sum(min(a[s], b[s]) * weight[s] for s in a.keys() & b.keys()) / sum(max(a[s], b[s]) * weight[s] for s in a.keys() | b.keys())


def check_pieces(rows, ids):
    at, used, places = collections.defaultdict(int), collections.Counter(), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
        used[r.sequence_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for s in places.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
    padding = sum(1024 - n for n in used.values() if n & (n - 1))
    assert max(used.values()) <= 1024 and padding <= 0.01 * sum(used.values())
