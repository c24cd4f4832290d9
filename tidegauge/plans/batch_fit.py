"""Second-stage problems of many (importer, good) cells at once: rows of all cells in one array, sums by cell."""

from __future__ import annotations

import math

import numpy as np

from .cell_fit import export_side, import_side

LOW, HIGH = math.log(1e-6), 300.0
NAN = float("nan")


class Batch:
    """Cells side by side. Import rows are sorted by cell: ``of`` is a row's cell, ``on`` an export row's import row; sigma,
    prior (log, NaN if unknown) and lam are by cell. A residual depends on its cell's gamma_k and on one gamma_j, so the
    normal equations of every cell are an arrow, and all arrows are solved in the same few array operations."""

    def __init__(self, of, sigma, y, x, w, on, ey, ex, sv, gv, prior, lam, numeric=False, printed=False):
        self.of, self.sigma, self.y, self.x, self.w = of, sigma, y, x, w
        self.on, self.ey, self.ex, self.sv, self.gv = on, ey, ex, sv, gv
        self.prior, self.lam, self.numeric = prior, np.broadcast_to(lam, sigma.shape), numeric
        self.printed = printed  # signs of the export equation as published
        self.cells, self.rows = len(sigma), len(of)
        self.pull = np.where((self.lam > 0) & ~np.isnan(prior), self.lam, 0.0)
        self.centre = np.where(np.isnan(prior), 0.0, prior)

    def take(self, cells: np.ndarray) -> Batch:
        """The problem of some cells (a mask), in the same order."""
        rows = cells[self.of]
        side = rows[self.on]
        at, row = np.cumsum(cells) - 1, np.cumsum(rows) - 1
        return Batch(
            at[self.of[rows]], self.sigma[cells], self.y[rows], self.x[rows], self.w[rows], row[self.on[side]], self.ey[side], self.ex[side], self.sv[side], self.gv[side], self.prior[cells], self.lam[cells], self.numeric, self.printed,
        )

    def by_cell(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, v, self.cells)

    def by_row(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.on, v, self.rows) if len(self.on) else np.zeros(self.rows)

    def parts(self, gk, gj, sigma=None):
        """Residuals and derivatives of the import rows (gamma_k and gamma_j by row) and of the export rows."""
        s = (self.sigma if sigma is None else sigma)[self.of]
        imp = lambda k, j: import_side(k, j, s, self.y, self.x)
        exp = lambda j: export_side(j[self.on], s[self.on], self.ey, self.ex, self.sv, self.gv, self.printed)
        (r, dk, dj), (re, de) = imp(gk, gj), exp(gj)
        if self.numeric:  # central differences
            hk, hj = 1e-6 * gk, 1e-6 * gj
            dk, dj = (imp(gk + hk, gj)[0] - imp(gk - hk, gj)[0]) / (2 * hk), (imp(gk, gj + hj)[0] - imp(gk, gj - hj)[0]) / (2 * hj)
            de = (exp(gj + hj)[0] - exp(gj - hj)[0]) / (2 * hj[self.on])
        return r, dk, dj, re, de

    def row_values(self, gk, gj) -> np.ndarray:
        """What each import row, its export rows and its gamma_j's prior add to the objective; gk by row."""
        s = self.sigma[self.of]
        r = import_side(gk, gj, s, self.y, self.x)[0]
        out = self.w * r**2 + self.pull[self.of] * (np.log(gj) - self.centre[self.of]) ** 2
        if len(self.on):
            re = export_side(gj[self.on], s[self.on], self.ey, self.ex, self.sv, self.gv, self.printed)[0]
            out = out + self.by_row(self.w[self.on] * re**2)
        return out

    def value(self, gk, gj) -> np.ndarray:
        return self.by_cell(self.row_values(gk[self.of], gj)) + self.pull * (np.log(gk) - self.centre) ** 2

    def arrow(self, gk, gj, sigma=None):
        """(J'WJ: corner, row, diagonal; J'Wr: corner, rest) in gamma: corners by cell, the rest by row."""
        r, dk, dj, re, de = self.parts(gk[self.of], gj, sigma)
        we = self.w[self.on]
        return (
            self.by_cell(self.w * dk**2), self.w * dk * dj, self.w * dj**2 + self.by_row(we * de**2),
            self.by_cell(self.w * dk * r), self.w * dj * r + self.by_row(we * de * re),
        )

    def solve(self, a, b, d, g0, g):
        """All arrow systems [[a, b'], [b, diag d]] x = (g0, g)."""
        d = np.where(d > 0, d, 1e-300)
        s = a - self.by_cell(b * b / d)
        x0 = np.where(s != 0, (g0 - self.by_cell(b * g / d)) / np.where(s != 0, s, 1), NAN)
        return x0, (g - b * x0[self.of]) / d

    def fit(self, start: np.ndarray, start_rows: np.ndarray | None = None, rounds: int = 200, tol: float = 1e-10):
        """Damped Gauss-Newton steps in log gamma from one start by cell, or from one by cell and one by row, every cell
        with its own damping and end: (gamma_k by cell, gamma_j by
        row, value, code). Code 0: the steps or the slope have died down; 1: the rounds are over; 52: no step helps any
        more though the slope is steep. Cells that are done leave the arrays."""
        with np.errstate(all="ignore"):
            logs = lambda x: np.log(np.maximum(x, 1e-6))
            return self._fit(logs(start), logs(start[self.of] if start_rows is None else start_rows), rounds, tol)

    def _fit(self, tk, tj, rounds, tol):
        p, cells, rows = self, np.arange(self.cells), np.arange(self.rows)
        out_k, out_j, out_v, code = tk.copy(), tj.copy(), np.empty(self.cells), np.ones(self.cells, int)
        damp, best = np.full(self.cells, 1e-3), p.value(np.exp(tk), np.exp(tj))
        out_v[:] = best
        for _ in range(rounds):
            if not len(cells):
                break
            gk, gj = np.exp(tk), np.exp(tj)
            a, b, d, g0, g = p.arrow(gk, gj)
            pull = p.pull[p.of]
            a, b, d = a * gk * gk + p.pull, b * gk[p.of] * gj, d * gj * gj + pull
            g0, g = g0 * gk + p.pull * (tk - p.centre), g * gj + pull * (tj - p.centre[p.of])
            free_k = ~(((tk <= LOW) & (g0 > 0)) | ((tk >= HIGH) & (g0 < 0)))
            free = ~(((tj <= LOW) & (g > 0)) | ((tj >= HIGH) & (g < 0)))
            b, g0, g = np.where(free & free_k[p.of], b, 0), np.where(free_k, g0, 0), np.where(free, g, 0)
            nk, nj, now, stuck = self._step(p, tk, tj, a, b, d, g0, g, damp, best)
            gain, best = np.where(stuck, 0, best - now), np.where(stuck, best, now)
            damp = np.where(stuck, damp, np.maximum(damp / 5, 1e-9))
            tk, tj = nk, nj
            steep = np.abs(g0)
            np.maximum.at(steep, p.of, np.abs(g))
            flat = steep <= 1e-5 * (np.abs(best) + 1e-8)
            ended = stuck | (gain <= tol * (np.abs(best) + 1e-12))
            out_k[cells], out_j[rows], out_v[cells] = tk, tj, best
            code[cells[ended]] = np.where(stuck & ~flat, 52, 0)[ended]
            if ended.any():
                left, mine = ~ended, ~ended[p.of]
                p, cells, rows = p.take(left), cells[left], rows[mine]
                tk, tj, damp, best = tk[left], tj[mine], damp[left], best[left]
        return np.exp(out_k), np.exp(out_j), out_v, code

    @staticmethod
    def _step(p, tk, tj, a, b, d, g0, g, damp, best):
        """One step of every cell, damped until it does not rise: (log gamma_k, log gamma_j, value, whether no step helps).
        Later tries are made for the cells that still need them; damp is raised in place."""
        nk, nj, now = tk.copy(), tj.copy(), best.copy()
        stuck = np.zeros(p.cells, bool)
        cells, rows, sub = np.arange(p.cells), np.arange(p.rows), p
        while len(cells):
            h = damp[cells]
            x0, xs = sub.solve(a[cells] * (1 + h) + 1e-12, b[rows], d[rows] * (1 + h[sub.of]) + 1e-12, g0[cells], g[rows])
            finite = np.isfinite(x0) & (sub.by_cell(~np.isfinite(xs)) == 0)
            ck = np.clip(tk[cells] - np.clip(x0, -3, 3), LOW, HIGH)
            cj = np.clip(tj[rows] - np.clip(xs, -3, 3), LOW, HIGH)
            value = sub.value(np.exp(ck), np.exp(cj))
            good = finite & (value <= best[cells])
            nk[cells[good]], now[cells[good]] = ck[good], value[good]
            mine = good[sub.of]
            nj[rows[mine]] = cj[mine]
            damp[cells[~good]] *= 4
            dead = ~good & (damp[cells] > 1e12)
            stuck[cells[dead]] = True
            more = ~good & ~dead
            if not more.all():
                rows, cells, sub = rows[more[sub.of]], cells[more], sub.take(more)
        return nk, nj, now, stuck

    def search(self, points: int = 17, rounds: int = 8, low: float = LOW, high: float = math.log(1e6)):
        """(gamma_k, gamma_j, value) without derivatives: at a given gamma_k the objective falls apart by gamma_j, so an outer
        search over gamma_k holds an inner one over every gamma_j by itself. Both are grids, even in logs, that close in
        on their best point; all cells and rows move together."""
        def closing(size, at):
            """at(point) -> values; (best point, its value) of ``size`` searches side by side."""
            lo, hi = np.full(size, low), np.full(size, high)
            best, least = lo.copy(), np.full(size, np.inf)
            for _ in range(rounds):
                step = (hi - lo) / (points - 1)
                for i in range(points):
                    x = lo + i * step
                    v = at(x)
                    less = v < least
                    best, least = np.where(less, x, best), np.where(less, v, least)
                lo, hi = np.maximum(best - step, low), np.minimum(best + step, high)
            return best, least

        def inner(tk):
            return closing(self.rows, lambda tj: np.nan_to_num(self.row_values(np.exp(tk)[self.of], np.exp(tj)), nan=np.inf))

        def outer(tk):
            return self.by_cell(inner(tk)[1]) + self.pull * (tk - self.centre) ** 2

        with np.errstate(all="ignore"):
            tk, value = closing(self.cells, outer)
            return np.exp(tk), np.exp(inner(tk)[0]), value

    def fit_or_search(self, start: np.ndarray, start_rows: np.ndarray | None = None):
        """fit, then a second try by ``search`` for the cells that it left with code 52; the better of both counts as
        converged, so a cell's value never rises."""
        gk, gj, value, code = self.fit(start, start_rows)
        again = code == 52
        if again.any():
            k, j, v = self.take(again).search()
            better = v < value[again]
            ids, rows = np.flatnonzero(again), np.flatnonzero(again[self.of])
            mine = better[np.cumsum(again)[self.of[rows]] - 1]
            gk[ids[better]], value[ids[better]], gj[rows[mine]] = k[better], v[better], j[mine]
            code[ids] = 0
        return gk, gj, value, code

    def at_sigmas(self, sigmas: np.ndarray) -> Batch:
        """The cells once for each column of ``sigmas`` (cells x points), one copy of all after the other."""
        k = sigmas.shape[1]
        shift = np.arange(k).repeat(self.rows)
        each = lambda v: np.concatenate([v] * k)
        return Batch(
            each(self.of) + shift * self.cells, sigmas.T.ravel(), each(self.y), each(self.x), each(self.w), each(self.on) + np.arange(k).repeat(len(self.on)) * self.rows,
            each(self.ey), each(self.ex), each(self.sv), each(self.gv), each(self.prior), each(self.lam), self.numeric, self.printed,
        )

    def joint(self, start: np.ndarray, low: float = 1 + 1e-6, high: float = 200.0, points: int = 13, rounds: int = 7):
        """(sigma, gamma_k, gamma_j, value, code) of the joint problems: the gammas are fitted at every sigma of a grid, even
        in log(sigma - 1), which closes in on each cell's best sigma. All cells and grid points are one batch."""
        a, b = np.full(self.cells, math.log(low - 1)), np.full(self.cells, math.log(high - 1))
        sigma, gk, gj, least, code = np.full(self.cells, NAN), np.full(self.cells, NAN), np.full(self.rows, NAN), np.full(self.cells, np.inf), np.ones(self.cells, int)
        for _ in range(rounds):
            x = a[:, None] + (b - a)[:, None] * np.linspace(0, 1, points)
            k, j, v, c = (part.reshape(points, -1) for part in self.at_sigmas(1 + np.exp(x)).fit(np.concatenate([start] * points)))
            at, cells, rows = v.argmin(0), np.arange(self.cells), np.arange(self.rows)
            less = v[at, cells] < least
            sigma, least = np.where(less, 1 + np.exp(x[cells, at]), sigma), np.where(less, v[at, cells], least)
            gk, code = np.where(less, k[at, cells], gk), np.where(less, c[at, cells], code)
            gj = np.where(less[self.of], j[at[self.of], rows], gj)
            a, b = x[cells, np.maximum(at - 1, 0)], x[cells, np.minimum(at + 1, points - 1)]
        return sigma, gk, gj, least, code

    def curvature(self, gk, gj):
        """J'WJ plus the prior's curvature (added whenever it is switched on, also where no prior is known)."""
        a, b, d, _, _ = self.arrow(gk, gj)
        lam = self.lam[self.of]
        return a, b, d, np.where(gk > 1e-8, 2 * self.lam / gk**2, 0.0), np.where(gj > 1e-8, 2 * lam / gj**2, 0.0)

    def errors(self, gk, gj, low: float = 0.01, high: float = 5.0):
        """((se, status, exposure, shrink weight) of the gamma_k, the same of the gamma_j)."""
        with np.errstate(all="ignore"):
            n, m = self.by_cell(np.ones(self.rows)), np.bincount(self.of[self.on], minlength=self.cells) if len(self.on) else np.zeros(self.cells, int)
            few = m - 1 < 1  # rows less unknowns: n + m - (n + 1)
            a, b, d, pa, pd = self.curvature(gk, gj)
            r, _, _, re, _ = self.parts(gk[self.of], gj)
            scale = self.by_cell(self.w * r**2 + self.by_row(self.w[self.on] * re**2)) / np.maximum(m - 1, 1)
            shrink = [np.where(own + prior > 0, prior / np.where(own + prior > 0, own + prior, 1), NAN) for own, prior in ((a, pa), (d, pd))]
            a, d = a + pa, d + pd
            flat = self.by_cell(d == 0) > 0
            safe = np.where(d == 0, 1, d)
            s = a - self.by_cell(b * b / safe)
            singular = ~few & (flat | (s == 0))
            s = np.where(s == 0, 1, s)
            var = scale / s, scale[self.of] * (1 / safe + b**2 / (safe**2 * s[self.of]))
            out = []
            exposure = n.astype(int), 1 + (np.bincount(self.on, minlength=self.rows) if len(self.on) else np.zeros(self.rows, int))
            for g, v, e, w, at in ((gk, var[0], exposure[0], shrink[0], slice(None)), (gj, var[1], exposure[1], shrink[1], self.of)):
                status = np.where(g < low, "boundary", np.where(g > high, "plateau", np.where(v > 0, "ok", "negative_diag"))).astype(object)
                status = np.where(few[at], "insufficient_df", np.where(singular[at], "singular", status))
                out.append((np.where(status == "ok", np.sqrt(np.maximum(v, 0)), NAN), status, e, np.where(few[at], NAN, w)))
            return out

    def slopes(self, gk, gj, step: float = 1e-4):
        """d gamma / d sigma by the implicit function theorem, residuals differenced centrally in sigma."""
        with np.errstate(all="ignore"):
            h = np.minimum(step, (self.sigma - 1) / 10)
            up, down = self.parts(gk[self.of], gj, self.sigma + h), self.parts(gk[self.of], gj, self.sigma - h)
            r, e = (up[0] - down[0]) / (2 * h[self.of]), (up[3] - down[3]) / (2 * h[self.of[self.on]])
            _, dk, dj, _, de = self.parts(gk[self.of], gj)
            g = self.w * dj * r + self.by_row(self.w[self.on] * de * e)
            a, b, d, pa, pd = self.curvature(gk, gj)
            return self.solve(a + pa, b, d + pd, -self.by_cell(self.w * dk * r), -g)
