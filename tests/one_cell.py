"""A second-stage problem of one cell, written without batches: the twin that the batch solver is compared with."""

import math

import numpy as np

from tidegauge.plans.cell_fit import export_side, import_side

NAN = float("nan")


class Stage2:
    """One cell's second-stage problem. ``on``: for each export row, the index of its exporter."""

    def __init__(self, sigma, y, x, w, ey, ex, on, sv, gv, prior, lam, numeric=False):
        self.numeric = numeric
        self.sigma, self.y, self.x, self.w = sigma, y, x, w
        self.ey, self.ex, self.on, self.sv, self.gv = ey, ex, on, sv, gv
        self.prior, self.lam = prior, lam

    def parts(self, gk, gj, sigma=None):
        sigma = sigma or self.sigma
        imp = lambda k, j: import_side(k, j, sigma, self.y, self.x)
        exp = lambda j: export_side(j[self.on], sigma, self.ey, self.ex, self.sv, self.gv) if len(self.on) else (np.zeros(0), np.zeros(0))
        (r, dk, dj), (re, de) = imp(gk, gj), exp(gj)
        if self.numeric:  # central differences; a residual depends on gamma_k and on one gamma_j
            hk, hj = 1e-6 * gk, 1e-6 * gj
            dk, dj = (imp(gk + hk, gj)[0] - imp(gk - hk, gj)[0]) / (2 * hk), (imp(gk, gj + hj)[0] - imp(gk, gj - hj)[0]) / (2 * hj)
            de = (exp(gj + hj)[0] - exp(gj - hj)[0]) / (2 * hj[self.on])
        return r, dk, dj, re, de

    def value(self, gk, gj) -> float:
        r, _, _, re, _ = self.parts(gk, gj)
        out = float(self.w @ r**2 + self.w[self.on] @ re**2)
        if self.lam > 0 and self.prior == self.prior:
            out += self.lam * float(((np.log(np.r_[gk, gj]) - self.prior) ** 2).sum())
        return out

    def arrow(self, gk, gj, sigma=None):
        """(J'WJ: corner, row, diagonal; J'Wr: corner, rest) in gamma."""
        r, dk, dj, re, de = self.parts(gk, gj, sigma)
        we = self.w[self.on]
        more = lambda x: np.bincount(self.on, x, len(gj)) if len(self.on) else np.zeros(len(gj))
        return float(self.w @ dk**2), self.w * dk * dj, self.w * dj**2 + more(we * de**2), float(self.w @ (dk * r)), self.w * dj * r + more(we * de * re)

    @staticmethod
    def solve(a, b, d, g0, g):
        """The arrow system [[a, b'], [b, diag d]] x = (g0, g)."""
        d = np.where(d > 0, d, 1e-300)
        s = a - float((b * b / d).sum())
        x0 = (g0 - float((b * g / d).sum())) / s if s else NAN
        return x0, (g - b * x0) / d

    def fit(self, start: float, rounds: int = 200, tol: float = 1e-10):
        """Damped Gauss-Newton in log gamma (each step one arrow solve): (gamma_k, gamma_j, value, convergence), 0 only
        where the steps or the slope have died down, 1 where the rounds are over and 52 where no step helps any more
        though the slope is steep. gamma is at least 1e-6 and has no upper bound but the numbers' own."""
        lo, hi = math.log(1e-6), 300.0
        tk, tj = math.log(max(start, 1e-6)), np.full(len(self.y), math.log(max(start, 1e-6)))
        damp, best = 1e-3, self.value(math.exp(tk), np.exp(tj))
        with_prior = self.lam > 0 and self.prior == self.prior
        for _ in range(rounds):
            gk, gj = math.exp(tk), np.exp(tj)
            a, b, d, g0, g = self.arrow(gk, gj)
            a, b, d, g0, g = a * gk * gk, b * gk * gj, d * gj * gj, g0 * gk, g * gj
            if with_prior:
                a, d, g0, g = a + self.lam, d + self.lam, g0 + self.lam * (tk - self.prior), g + self.lam * (tj - self.prior)
            free_k = not ((tk <= lo and g0 > 0) or (tk >= hi and g0 < 0))
            free = ~(((tj <= lo) & (g > 0)) | ((tj >= hi) & (g < 0)))
            while True:
                x0, xs = self.solve(a * (1 + damp) + 1e-12, np.where(free & free_k, b, 0), d * (1 + damp) + 1e-12, g0 if free_k else 0.0, np.where(free, g, 0))
                if math.isfinite(x0) and np.isfinite(xs).all():
                    nk, nj = min(max(tk - min(max(x0, -3), 3), lo), hi), np.clip(tj - np.clip(xs, -3, 3), lo, hi)
                    now = self.value(math.exp(nk), np.exp(nj))
                    if now <= best:
                        break
                damp *= 4
                if damp > 1e12:
                    steep = max(abs(g0) if free_k else 0.0, float(np.abs(np.where(free, g, 0)).max(initial=0.0)))
                    return gk, gj, best, 0 if steep <= 1e-5 * (abs(best) + 1e-8) else 52
            gain, best, tk, tj, damp = best - now, now, nk, nj, max(damp / 5, 1e-9)
            if gain <= tol * (abs(best) + 1e-12):
                return math.exp(tk), np.exp(tj), best, 0
        return math.exp(tk), np.exp(tj), best, 1

    def curvature(self, gk, gj):
        """J'WJ plus the prior's curvature (added whenever it is switched on, also where no prior is known)."""
        a, b, d, _, _ = self.arrow(gk, gj)
        return a, b, d, (2 * self.lam / gk**2 if gk > 1e-8 else 0.0), np.where(gj > 1e-8, 2 * self.lam / gj**2, 0.0)

    def errors(self, gk, gj, low: float = 0.01, high: float = 5.0):
        """(se, status, exposure, shrink weight) for gamma_k first, then each gamma_j."""
        g = np.r_[gk, gj]
        m, k = len(self.ey), len(g)
        exposure = np.r_[len(gj), 1 + np.bincount(self.on, minlength=len(gj))].astype(int) if m else np.r_[len(gj), np.ones(len(gj), int)]
        if len(gj) + m - k < 1:
            return np.full(k, NAN), ["insufficient_df"] * k, exposure, np.full(k, NAN)
        a, b, d, pa, pd = self.curvature(gk, gj)
        r, _, _, re, _ = self.parts(gk, gj)
        scale = float(self.w @ r**2 + self.w[self.on] @ re**2) / (len(gj) + m - k)
        own, prior = np.r_[a, d], np.r_[pa, pd]
        shrink = np.where(own + prior > 0, prior / np.where(own + prior > 0, own + prior, 1), NAN)
        a, d = a + pa, d + pd
        if (d == 0).any():
            return np.full(k, NAN), ["singular"] * k, exposure, shrink
        s = a - float((b * b / d).sum())
        if s == 0:
            return np.full(k, NAN), ["singular"] * k, exposure, shrink
        var = scale * np.r_[1 / s, 1 / d + b**2 / (d**2 * s)]
        status = np.where(g < low, "boundary", np.where(g > high, "plateau", np.where(var > 0, "ok", "negative_diag")))
        return np.where(status == "ok", np.sqrt(np.maximum(var, 0)), NAN), status.tolist(), exposure, shrink

    def slopes(self, gk, gj, step: float = 1e-4):
        """d gamma / d sigma by the implicit function theorem, residuals differenced centrally in sigma."""
        h = min(step, (self.sigma - 1) / 10)
        up, down = self.parts(gk, gj, self.sigma + h), self.parts(gk, gj, self.sigma - h)
        r, e = (up[0] - down[0]) / (2 * h), (up[3] - down[3]) / (2 * h)
        _, dk, dj, _, de = self.parts(gk, gj)
        g = self.w * dj * r + (np.bincount(self.on, self.w[self.on] * de * e, len(gj)) if len(self.on) else 0.0)
        a, b, d, pa, pd = self.curvature(gk, gj)
        x0, xs = self.solve(a + pa, b, d + pd, -float(self.w @ (dk * r)), -g)
        return np.r_[x0, xs]


def joint(problem: Stage2, start: float, low: float = 1 + 1e-6, high: float = 200.0) -> tuple[float, float, np.ndarray, float, int]:
    """(sigma, gamma_k, gamma_j, value, convergence) of the joint problem: the gammas are fitted at each sigma (lam is 0
    there), and the best sigma of a grid, even in log(sigma - 1), is refined by narrower grids."""
    fits: dict[float, tuple] = {}

    def at(sigma):
        if sigma not in fits:
            problem.sigma = sigma
            fits[sigma] = problem.fit(start)
        return fits[sigma][2]

    a, b = math.log(low - 1), math.log(high - 1)
    for _ in range(7):
        grid = [1 + math.exp(x) for x in np.linspace(a, b, 13)]
        k = min(range(13), key=lambda i: at(grid[i]))
        a, b = math.log(grid[max(k - 1, 0)] - 1), math.log(grid[min(k + 1, 12)] - 1)
    sigma = min(fits, key=lambda x: fits[x][2])
    return sigma, *fits[sigma]
