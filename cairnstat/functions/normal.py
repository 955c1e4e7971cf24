"""Normal distribution functions as SQL text, so Spark stays in the JVM and the same text runs in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16), lowest order first.
CENTRAL_NUM = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
CENTRAL_DEN = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
MIDDLE_NUM = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640)
MIDDLE_DEN = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9)
FAR_NUM = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
FAR_DEN = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _horner(c: tuple, x: str) -> str:
    out = f"CAST({c[-1]!r} AS DOUBLE)"
    for a in c[-2::-1]:
        out = f"({out} * {x} + CAST({a!r} AS DOUBLE))"
    return out


def quantile_sql(p: str) -> str:
    """SQL text of the standard normal quantile of ``p``, which lies strictly between 0 and 1."""
    q = f"(({p}) - 0.5e0)"
    s = f"(0.180625e0 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1e0 - ({p}))))"
    tail = lambda num, den, shift: f"({_horner(num, f'({r} - {shift})')} / {_horner(den, f'({r} - {shift})')})"
    return (
        f"CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {_horner(CENTRAL_NUM, s)} / {_horner(CENTRAL_DEN, s)} "
        f"ELSE sign({q}) * CASE WHEN {r} <= 5e0 THEN {tail(MIDDLE_NUM, MIDDLE_DEN, '1.6e0')} ELSE {tail(FAR_NUM, FAR_DEN, '5e0')} END END"
    )


def quantile(name: str) -> Column:
    """Standard normal quantile of the column ``name``."""
    return F.expr(quantile_sql(f"`{name}`"))
