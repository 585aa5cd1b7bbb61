"""Brute-force counterparts."""


def ascii_lower(t):
    return t.encode().lower().decode()


def shingle_sets(texts, n):
    out = {}
    for i, t in texts.items():
        ws = ascii_lower(t or "").split()
        k = min(n, len(ws))
        out[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if ws else set()
    return out


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                same = len(x & y)
                if 100 * same >= percent * (len(x) + len(y) - same):
                    p, q = root(ids[a]), root(ids[b])
                    parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}
