"""Full-matrix distances in plain Python, for comparison."""

import math

INF = math.inf


def point(e):
    return lambda a, b: abs(a - b) if e == 1 else (a - b) * (a - b) if e == 2 else abs(a - b) ** e


def _ends(a, b, w=None):
    if not a and not b:
        return 0.0
    if not a or not b or (w is not None and abs(len(a) - len(b)) > w):
        return INF
    return None


def dtw(a, b, e=2, w=None, p=0.0, weights=None):
    if (r := _ends(a, b, w)) is not None:
        return r
    c, n, m = point(e), len(a), len(b)
    d = [[INF] * m for _ in range(n)]
    for i in range(n):
        for j in range(m):
            if w is not None and abs(i - j) > w:
                continue
            x = c(a[i], b[j]) * (weights[abs(i - j)] if weights else 1)
            if i == j == 0:
                d[0][0] = x
                continue
            left, top, diag = (d[i][j - 1] if j else INF), (d[i - 1][j] if i else INF), (d[i - 1][j - 1] if i and j else INF)
            d[i][j] = min(left + x + p, top + x + p, diag + x) if p else min(left, top, diag) + x
    return d[-1][-1]


def directa(a, b, e=2):
    return INF if len(a) != len(b) else sum(map(point(e), a, b)) if a else 0.0


def erp(a, b, g=0.0, e=2, w=None):
    if (r := _ends(a, b, w)) is not None:
        return r
    c, n, m = point(e), len(a), len(b)
    w = max(n, m) if w is None else w
    d = [[INF] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for j in range(1, min(m, w + 1) + 1):
        d[0][j] = d[0][j - 1] + c(b[j - 1], g)
    for i in range(1, n + 1):
        if i <= w + 1:
            d[i][0] = d[i - 1][0] + c(a[i - 1], g)
        for j in range(1, m + 1):
            if abs(i - j) <= w:
                d[i][j] = min(d[i][j - 1] + c(b[j - 1], g), d[i - 1][j - 1] + c(a[i - 1], b[j - 1]), d[i - 1][j] + c(a[i - 1], g))
    return d[n][m]


def lcss(a, b, eps, w=None):
    if (r := _ends(a, b, w)) is not None:
        return r
    n, m = len(a), len(b)
    w = max(n, m) if w is None else w
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(i - j) <= w:
                d[i][j] = d[i - 1][j - 1] + 1 if abs(a[i - 1] - b[j - 1]) < eps else max(d[i - 1][j], d[i][j - 1], d[i - 1][j - 1])
    return 1 - d[n][m] / min(n, m)


def msm(a, b, c):
    if (r := _ends(a, b)) is not None:
        return r

    def move(new, x, y):
        return c if x <= new <= y or y <= new <= x else c + min(abs(new - x), abs(new - y))

    d = [[INF] * len(b) for _ in a]
    for i in range(len(a)):
        for j in range(len(b)):
            if i == j == 0:
                d[0][0] = abs(a[0] - b[0])
                continue
            d[i][j] = min(
                d[i - 1][j - 1] + abs(a[i] - b[j]) if i and j else INF,
                d[i - 1][j] + move(a[i], a[i - 1], b[j]) if i else INF,
                d[i][j - 1] + move(b[j], b[j - 1], a[i]) if j else INF,
            )
    return d[-1][-1]


def twe(a, b, nu, lam):
    if (r := _ends(a, b)) is not None:
        return r
    d = [[INF] * len(b) for _ in a]
    for i in range(len(a)):
        for j in range(len(b)):
            if i == j == 0:
                d[0][0] = (a[0] - b[0]) ** 2
                continue
            d[i][j] = min(
                d[i - 1][j - 1] + (a[i] - b[j]) ** 2 + (a[i - 1] - b[j - 1]) ** 2 + 2 * nu * abs(i - j) if i and j else INF,
                d[i - 1][j] + (a[i] - a[i - 1]) ** 2 + nu + lam if i else INF,
                d[i][j - 1] + (b[j] - b[j - 1]) ** 2 + nu + lam if j else INF,
            )
    return d[-1][-1]


def envelope(s, w, pick):
    return [pick(s[max(0, i - w) : i + w + 1]) for i in range(len(s))]


def keogh(q, u, low, e=2):
    c = point(e)
    return sum(c(x, y) if x > y else c(x, z) if x < z else 0.0 for x, y, z in zip(q, u, low))


def derive(s):
    if len(s) <= 2:
        return list(s)
    inner = [((s[i] - s[i - 1]) + (s[i + 1] - s[i - 1]) / 2) / 2 for i in range(1, len(s) - 1)]
    return [inner[0], *inner, inner[-1]]


def weights(g, n, wmax=1.0):
    return [wmax / (1 + math.exp(-g * (i - n / 2))) for i in range(n)]
