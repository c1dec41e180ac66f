"""Inverse of the normal distribution function for whole arrays."""

from __future__ import annotations

import numpy as np

# fixed values: numerators and denominators of Wichura's rational approximations (Applied Statistics 37, AS 241), highest power first,
# for |p - 1/2| <= 0.425, for sqrt(-log(tail)) <= 5 and beyond
CENTRE = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
          [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0])
TAIL = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
        [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0])
FAR = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
       [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0])


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal distribution; NaN outside (0, 1)."""
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    p = np.where(inside, p, 0.5)
    q = p - 0.5
    ratio = lambda part, r: np.polyval(part[0], r) / np.polyval(part[1], r)
    near = q * ratio(CENTRE, 0.180625 - q * q)
    r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    far = np.sign(q) * np.where(r <= 5.0, ratio(TAIL, r - 1.6), ratio(FAR, r - 5.0))
    return np.where(inside, np.where(np.abs(q) <= 0.425, near, far), np.nan)
