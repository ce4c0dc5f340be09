"""Small tables and plain definitions that the operators are held against."""

import re
from collections import Counter


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def word_sets(texts):
    """Distinct five-word shingles of each text."""
    out = []
    for x in texts:
        words = [q for q in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) if q]
        out.append({tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    return out


def units(text):
    """Start, end, words in small letters and their number, of each unit of a text, read character by character."""
    small, found, start, k = lambda c: len(c.lower()) == 1 and c.lower() or c, [], 0, 0
    letter = lambda c: c != "" and re.fullmatch(r"[^\W\d_]", c) is not None
    capital = lambda c: c != "" and ("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×")

    def close(end):
        words = re.findall(r"\w+", text[start:end])
        if words:
            found.append((start, end, " ".join("".join(map(small, w)) for w in words), len(words)))

    while k < len(text):
        stop = k
        while stop < len(text) and text[stop] != "\n" and text[stop].isspace():
            stop += 1
        if text[k] == "\n":
            close(k)
            k = start = k + 1
        elif stop > k:
            before, after, then = text[k - 1 : k], text[stop : stop + 1], text[stop + 1 : stop + 2]
            if before in (".", "!", "?") or letter(before) and not capital(before) and capital(after) and letter(then) and not capital(then):
                close(k)
                start = stop
            k = stop
        else:
            k += 1
    close(len(text))
    return found


def components(n, links):
    up = list(range(n))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def similar_groups(ids, texts, percent=75):
    """(id, set size, smallest id of the group) by comparing all that share a shingle."""
    sets, where, links = word_sets(texts), {}, []
    for i, own in enumerate(sets):
        shared = Counter()
        for t in own:
            shared.update(where.get(t, ()))
            where.setdefault(t, []).append(i)
        links += [(i, j) for j, n in shared.items() if 100 * n >= percent * (len(own) + len(sets[j]) - n)]
    roots = components(len(ids), links)
    least = {}
    for k, r in zip(ids, roots):
        least[r] = min(least.get(r, k), k)
    return sorted((k, len(s), least[r]) for k, s, r in zip(ids, sets, roots))
