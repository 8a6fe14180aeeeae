"""Plain versions that tests compare with."""

import re

from tests.llm.test_simhash import brute_print


def near_groups(texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    groups = []
    for i, p in prints.items():
        near = [g for g in groups if any((prints[j] ^ p).bit_count() <= 2 for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [i])]
    return groups


def decontaminated(texts, items):
    def words(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    windows = set()
    for item in items:
        w = words(item or "")
        size = min(10, len(w))
        windows.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1) if w)
    sizes = {len(w) for w in windows}
    clean = []
    for i, text in texts.items():
        w = words(text)
        if not any(tuple(w[j:j + n]) in windows for n in sizes for j in range(len(w) - n + 1)):
            clean.append(i)
    return sorted(clean)


