"""The candidates of a split search as SQL over a table `hist` (f, bin, g, h, n), for the catalogue's oracles."""

from __future__ import annotations


def candidates_sql(direction="both", lam=1.0, alpha=0.0, max_delta=0.0, min_child=1.0, monotone=None) -> str:
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {alpha}, 0))"
    w = lambda g, h: f"greatest(-{max_delta}, least({max_delta}, -{soft(g)} / ({h} + {lam})))" if max_delta else f"(-{soft(g)} / ({h} + {lam}))"
    if max_delta or monotone:
        score = lambda g, h: f"(-(2 * {g} * {w(g, h)} + ({h} + {lam}) * pow({w(g, h)}, 2) + 2 * {alpha} * abs({w(g, h)})))"
    else:
        score = lambda g, h: f"({soft(g)} * {soft(g)} / ({h} + {lam}))"
    both = {"forward": "NOT default_left", "backward": "default_left", "both": "TRUE"}[direction]
    limits = "".join(f" AND (f <> {f} OR {w('lg', 'lh')} {'<=' if c > 0 else '>='} {w('rg', 'rh')})" for f, c in (monotone or {}).items())
    return f"""SELECT f, bin, default_left, round({score('lg', 'lh')} + {score('rg', 'rh')} - {score('tg', 'th')}, 2) AS gain FROM (
SELECT f, bin, dl AS default_left, lg, lh, tg, th, tg - lg AS rg, th - lh AS rh FROM (
  SELECT s.f, s.bin, d.dl, s.lg + CASE WHEN d.dl THEN coalesce(m.g, 0) ELSE 0 END AS lg, s.lh + CASE WHEN d.dl THEN coalesce(m.h, 0) ELSE 0 END AS lh, t.tg, t.th, coalesce(m.n, 0) AS mn, s.last
  FROM (SELECT f, bin, sum(g) OVER (PARTITION BY f ORDER BY bin) AS lg, sum(h) OVER (PARTITION BY f ORDER BY bin) AS lh, max(bin) OVER (PARTITION BY f) AS last FROM hist WHERE bin IS NOT NULL) s
  JOIN (SELECT f, sum(g) AS tg, sum(h) AS th FROM hist GROUP BY f) t ON t.f = s.f LEFT JOIN (SELECT * FROM hist WHERE bin IS NULL) m ON m.f = s.f, (VALUES (TRUE), (FALSE)) d(dl))
  WHERE NOT dl OR (mn > 0 AND bin < last)) WHERE {both} AND lh > 0 AND rh > 0 AND lh >= {min_child} AND rh >= {min_child}{limits}"""
