"""Normal distribution as column expressions.

Phi uses the published double-precision rational approximation of Hart in the
form given by G. West, "Better approximations to cumulative normal functions"
(2005). Its inverse is Wichura's algorithm AS 241 (1988).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Coefficients of the two published approximations.
HART_P = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_Q = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
AS241_A = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
           45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
AS241_B = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
           21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
AS241_C = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
           1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4)
AS241_D = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
           0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
AS241_E = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
           0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
AS241_F = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _falling(x: Column, coeffs) -> Column:
    y = F.lit(coeffs[0])
    for k in coeffs[1:]:
        y = y * x + k
    return y


def pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-0.5 * z * z)
    near = e * _falling(z, HART_P) / _falling(z, HART_Q)
    tail = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = z + k / tail
    far = e / (tail * 2.506628274631)
    upper = F.when(z > 37.0, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


def quantile(p: Column) -> Column:
    """Inverse of cdf for 0 < p < 1."""
    q = p - 0.5
    r = 0.180625 - q * q
    mid = q * _falling(r, AS241_A[::-1]) / _falling(r, AS241_B[::-1])
    s = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    a, b = s - 1.6, s - 5.0
    side = F.when(s <= 5.0, _falling(a, AS241_C[::-1]) / _falling(a, AS241_D[::-1])).otherwise(
        _falling(b, AS241_E[::-1]) / _falling(b, AS241_F[::-1]))
    return F.when(F.abs(q) <= 0.425, mid).otherwise(F.signum(q) * side)
