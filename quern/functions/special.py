"""Special functions behind p-values, on the driver or inside tasks: no statistics library is needed."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for k in range(1, 10_000):
        top = -k * (k - a)
        b += 2
        d = 1 / (top * d + b or tiny)
        c = b + top / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * out


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def student_two_sided(t: float, df: float) -> float:
    return beta_part(df / 2, 0.5, df / (df + t * t))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3:
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_greater(both: int, left: int, right: int, n: int) -> float:
    """P(at least `both` joint occurrences) with `left` and `right` of n drawn independently."""
    top = min(left, right)
    if both <= max(0, left + right - n):
        return 1.0
    base = log_choose(n, right)
    at = math.exp(log_choose(left, both) + log_choose(n - left, right - both) - base)
    total, k = at, both
    while k < top and at > 0:
        at *= (left - k) * (right - k) / ((k + 1) * (n - left - right + k + 1))
        k += 1
        total += at
        if at < total * 1e-17:
            break
    return min(1.0, total)


def signed_rank_p(differences: list[float]) -> float:
    """Two-sided Wilcoxon signed-rank p: zeros dropped; exact for up to 25 differences without ties or zeros."""
    used = [d for d in differences if d]
    n = len(used)
    if not n:
        return math.nan
    order = sorted(range(n), key=lambda k: abs(used[k]))
    ranks, k, ties = [0.0] * n, 0, 0.0
    while k < n:
        j = k
        while j + 1 < n and abs(used[order[j + 1]]) == abs(used[order[k]]):
            j += 1
        for i in range(k, j + 1):
            ranks[order[i]] = (k + j) / 2 + 1
        ties += (j - k + 1) ** 3 - (j - k + 1)
        k = j + 1
    plus = sum(r for r, d in zip(ranks, used, strict=True) if d > 0)
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 25 and not ties and n == len(differences):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, 2 * normal_tail(abs(low - n * (n + 1) / 4) / sd))


def friedman_p(ranks_by_block: list[list[float]]) -> tuple[float, float]:
    """Chi-square statistic with tie correction, and p, from ranks within blocks."""
    n, k = len(ranks_by_block), len(ranks_by_block[0])
    sums = [sum(block[j] for block in ranks_by_block) for j in range(k)]
    ties = sum(block.count(v) ** 3 - block.count(v) for block in ranks_by_block for v in set(block))
    correction = 1 - ties / (n * k * (k * k - 1))
    statistic = (12 / (n * k * (k + 1)) * sum(s * s for s in sums) - 3 * n * (k + 1)) / correction if correction else math.nan
    return statistic, chi2_tail(statistic, k - 1) if statistic == statistic else math.nan
