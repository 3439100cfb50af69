"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.llm.topk import quantised
from tabml.session import materialize

#: vectors may be so wide: the driver holds a scatter of WIDEST x WIDEST whole numbers at most
WIDEST = 1024
#: bits of a digit in which partial sums travel, bits of a limb whose products are exact in a double
DIGIT, LIMB = 40, 22
#: rows whose products are added up at once
ROWS = 256
#: roots are isolated to 2^-PLACES of a unit of the scatter, components are solved for with DIGITS decimal digits
PLACES, DIGITS = 128, 110


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of ``width`` whole numbers with the sums ``sums``; ``roots`` are the largest
    eigenvalues of n * n * covariance, ``axes`` their unit eigenvectors, ``trace`` the sum of all eigenvalues."""

    n: int
    width: int
    sums: tuple
    trace: int
    roots: tuple
    axes: tuple

    def explained(self) -> list:
        """Share of the variance per component; None where nothing varies."""
        return [float(Decimal(r) / self.trace) if self.trace else None for r in self.roots]


def whole_vectors(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * entry) of each usable row, as wide as the widest, zeros at the end."""
    rows = quantised(df, id, vector, scale)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if width > WIDEST:
        raise ValueError(f"vectors have {width} entries, at most {WIDEST} are whitened")
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))


def _matrix(column, width: int):
    import numpy as np
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _product(v):
    """v.T @ v in whole numbers, whatever their size: signed limbs whose products a double holds exactly."""
    import numpy as np

    most = int(np.abs(v).max(initial=0))
    count = max(1, -(-most.bit_length() // LIMB))
    limbs = [(np.sign(v) * (np.abs(v) >> (LIMB * k) & ((1 << LIMB) - 1))).astype(np.float64) for k in range(count)]
    total = 0
    for a in range(count):
        for b in range(count):
            total = total + ((limbs[a].T @ limbs[b]).astype(np.int64).astype(object) << (LIMB * (a + b)))
    return total


def _partial_scatter(width: int):
    """Sums of products of (1, v) over a task's rows, as signed digits (i, j, place, digit)."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            v = _matrix(batch.column(0), width)
            v = np.hstack([np.ones((len(v), 1), np.int64), v])
            for start in range(0, len(v), ROWS):
                total = total + _product(v[start:start + ROWS])
        rows = []
        for i in range(width + 1):
            for j in range(i, width + 1):
                sign, rest, place = (-1 if total[i, j] < 0 else 1), abs(int(total[i, j])), 0
                while rest:
                    rows.append((i, j, place, sign * (rest & ((1 << DIGIT) - 1))))
                    rest, place = rest >> DIGIT, place + 1
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "place", "digit"])
    return run


def scatter(vectors: DataFrame, width: int) -> tuple:
    """(n, sums, C) of the rows' ``v``: C = sum of (n x - S)(n x - S)' / n = n * sum of x x' - S S', exact."""
    parts = vectors.select("v").mapInArrow(_partial_scatter(width), "i long, j long, place long, digit long")
    total: dict = {}
    for r in parts.groupBy("i", "j", "place").agg(F.sum("digit").alias("digit")).collect():     # width x width numbers
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (r.digit << (DIGIT * r.place))
    at = lambda i, j: total.get((min(i, j), max(i, j)), 0)
    n, sums = at(0, 0), [at(0, i + 1) for i in range(width)]
    return n, sums, [[n * at(i + 1, j + 1) - sums[i] * sums[j] for j in range(width)] for i in range(width)]


def _is_prime(n: int) -> bool:
    """Miller-Rabin, proven for these bases below 3.2e9."""
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def _primes(beyond: int) -> list[int]:
    """Primes below 2^31, largest first, whose product exceeds a bound."""
    found, product, n = [], 1, (1 << 31) + 1
    while product <= beyond:
        n -= 2
        if _is_prime(n):
            found.append(n)
            product *= n
    return found


def polynomial_mod(matrix: list, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo p, constant first, by reduction to Hessenberg form."""
    import numpy as np

    d = len(matrix)
    a = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(d, d)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        a[[i, k + 1]] = a[[k + 1, i]]
        a[:, [i, k + 1]] = a[:, [k + 1, i]]
        m = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - m[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * m % p).sum(axis=1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)         # row k: polynomial of the leading k x k block
    found[0, 0] = 1
    for k in range(1, d + 1):
        row = -int(a[k - 1, k - 1]) * found[k - 1] % p
        row[1:] += found[k - 1, :-1]
        under = 1
        for i in range(k - 2, -1, -1):
            under = under * int(a[i + 1, i]) % p
            if not under:
                break
            row -= under * int(a[i, k - 1]) % p * found[i] % p
        found[k] = row % p
    return found[d].tolist()


def _residues(matrix: list):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            primes = batch.column(0).to_pylist()
            found = [polynomial_mod(matrix, p) for p in primes]
            yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["prime", "residues"])
    return run


def characteristic_polynomial(spark: SparkSession, matrix: list) -> list[int]:
    """Exact coefficients of det(x - matrix), constant first, of a symmetric matrix of whole numbers without
    negative eigenvalues: the polynomials modulo enough primes, a task per few of them, joined by Chinese
    remaindering. The k-th elementary symmetric sum of d eigenvalues is at most comb(d, k) * (trace / d) ** k."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    primes = _primes(max(comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1)))
    table = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(max(1, len(primes) // 8))
    found = table.mapInArrow(_residues(matrix), "prime long, residues array<long>").collect()      # primes x (width + 1)
    values, product = [0] * (d + 1), 1
    for r in found:
        inverse = pow(product, -1, r.prime)
        for k in range(d + 1):
            residue = r.residues[k] if (d - k) % 2 == 0 else -r.residues[k]
            values[k] += product * ((residue - values[k]) * inverse % r.prime)
        product *= r.prime
    return [v if (d - k) % 2 == 0 else -v for k, v in enumerate(values)]


def _above(coefficients: list[int], a: int) -> int:
    """How many roots lie above ``a``, of a polynomial whose roots are all real: the sign changes of p(x + a)."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], count: int, trace: int) -> list[int]:
    """The ``count`` largest roots, repeated ones as often, of a polynomial with real roots from 0 to trace:
    each the least multiple of 2^-PLACES that is not below it, in such units. Roots are parted by counting
    sign changes; one that is alone in its interval is refined by the sign of the polynomial."""
    d = len(coefficients) - 1
    scaled = [c << (PLACES * (d - k)) for k, c in enumerate(coefficients)]
    top, counts, roots = trace << PLACES, {}, []

    def above(a: int) -> int:
        """Asked at whole units first, where the numbers are short."""
        if a not in counts:
            counts[a] = _above(scaled, a) if a & ((1 << PLACES) - 1) else _above(coefficients, a >> PLACES)
        return counts[a]

    def sign(a: int) -> int:
        value = 0
        for c in reversed(scaled):
            value = value * a + c
        return (value > 0) - (value < 0)

    for rank in range(1, min(count, d) + 1):
        low, high = 0, top                             # the root lies above low and not above high
        if above(low) < rank:
            roots.append(0)
            continue
        while high - low > 1 and not (above(low) == rank and above(high) == rank - 1):
            middle = (low + high) // 2
            if high - low > 2 << PLACES:
                middle = middle >> PLACES << PLACES
            low, high = (low, middle) if above(middle) < rank else (middle, high)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sign(middle) == (-1) ** rank else (low, middle)
        roots.append(high)
    return roots


def eigenvectors(matrix: list, roots: list[Decimal]) -> list[list[float]]:
    """Unit vectors of the null spaces of matrix - root, by inverse iteration in DIGITS decimal digits. Vectors of
    equal roots are made orthogonal to each other; the largest entry is positive."""
    import numpy as np

    d, found = len(matrix), []
    with localcontext() as context:
        context.prec = DIGITS
        whole = np.array([[Decimal(x) for x in row] for row in matrix], object).reshape(d, d)
        size = max((abs(x) for x in whole.ravel()), default=Decimal(0)) or Decimal(1)
        least = size.scaleb(10 - DIGITS)
        for r, root in enumerate(roots):
            a = whole.copy()
            a[np.arange(d), np.arange(d)] -= root
            order = np.arange(d)
            for k in range(d):
                i = k + int(np.argmax(np.abs(a[k:, k])))
                a[[k, i]], order[[k, i]] = a[[i, k]], order[[i, k]]
                if abs(a[k, k]) < least:
                    a[k, k] = least
                a[k + 1:, k] /= a[k, k]
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
            equal = [v for v, other in zip(found, roots) if other == root]
            y = np.array([Decimal((7919 * (i + 1) * (r + 1)) % 1009 + 1) for i in range(d)], object)
            for _ in range(4):
                y = y[order]
                for k in range(d):
                    y[k + 1:] -= a[k + 1:, k] * y[k]
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - (a[k, k + 1:] * y[k + 1:]).sum()) / a[k, k]
                y = y / max(abs(x) for x in y)
                for v in equal:
                    y = y - v * (v * y).sum()
                y = y / (y * y).sum().sqrt()
            found.append(y if y[int(np.argmax(np.abs(y)))] > 0 else -y)
        return [[float(x) for x in v] for v in found]


def fit(vectors: DataFrame, components: int = 4) -> Whitening:
    """The whitening of the distinct ``v`` of ``whole_vectors``: distinct rows are counted once."""
    first = vectors.first()
    width = len(first.v) if first else 0
    n, sums, matrix = scatter(vectors, width)
    trace = sum(matrix[i][i] for i in range(width))
    if trace:
        places = largest_roots(characteristic_polynomial(vectors.sparkSession, matrix), components, trace)
    else:
        places = [0] * min(components, width)
    with localcontext() as context:
        context.prec = DIGITS
        roots = [Decimal(x) / (1 << PLACES) for x in places]
    return Whitening(n, width, tuple(sums), trace, tuple(roots), tuple(map(tuple, eigenvectors(matrix, roots))))


def _projected(model: Whitening):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums, count = np.array(model.sums, object), len(model.roots)
        axes = np.array([[x / float(r.sqrt()) if r else 0.0 for x in a] for r, a in zip(model.roots, model.axes)]).reshape(count, model.width).T
        still = np.array([not r for r in model.roots], bool)
        widest = max((abs(s) for s in model.sums), default=0)
        for batch in batches:
            v = _matrix(batch.column(1), model.width)
            most = model.n * int(np.abs(v).max(initial=0)) + widest
            short = most < 1 << 62
            centred = model.n * v - sums.astype(np.int64) if short else model.n * v.astype(object) - sums
            if most * most * max(model.width, 1) < 1 << 63:
                deviation = pa.array((centred * centred).sum(axis=1), pa.int64()).cast(pa.decimal128(38))
            else:
                exact = [sum(int(x) ** 2 for x in row) for row in centred]
                deviation = pa.array([Decimal(x) if x < 10 ** 38 else None for x in exact], pa.decimal128(38))
            values = centred.astype(np.float64) @ axes
            flat = pa.array(values.ravel(), mask=np.tile(still, len(v)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * count, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["id", "deviation", "whitened"])
    return run


def transform(model: Whitening, vectors: DataFrame) -> DataFrame:
    """(id, deviation, whitened) of (id, v): the squared distance of n * v from the sums (exact; NULL beyond 38
    digits) and v - mean on each component in units of its deviation (NULL on one without variance)."""
    return vectors.select("id", "v").mapInArrow(_projected(model), "id long, deviation decimal(38,0), whitened array<double>")


def identity_error(model: Whitening, vectors: DataFrame) -> float | None:
    """How far the covariance of the whitened ``vectors`` is from the identity, at its worst entry; None
    without a component that varies."""
    own = [k for k, r in enumerate(model.roots) if r]
    if not own:
        return None
    rows = transform(model, vectors.select(F.lit(None).cast("long").alias("id"), "v"))
    pairs = [(a, b) for a in own for b in own if a <= b]
    got = rows.agg(*[F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]) for a, b in pairs]).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, got))


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per usable row and component.

    Entries become floor(scale * entry) as longs. The fit list holds every distinct vector once. Its scatter is
    added up exactly by the tasks; its characteristic polynomial, the eigenvalues and the components
    follow without rounding but in their last step to doubles. Components are numbered from 1 by
    falling eigenvalue; there are at most as many as entries.

    Vectors that are NULL or hold NULL, NaN or infinities are left out; entries beyond a long stop
    at its ends. Shorter vectors, the empty one too, end in zeros up to the widest; beyond WIDEST
    entries the operator refuses. NULL ids and repeated rows are returned like others, copies weigh once.
    A component without variance (one distinct vector, say) has whitened NULL and explained 0, or
    NULL if nothing varies. Equal eigenvalues get some orthogonal basis. No rows: no rows.
    Other columns are not looked at.
    """
    rows = materialize(whole_vectors(df, id, vector, scale), "whitening")
    fitted = materialize(rows.select("v").distinct(), "whitening-fit")
    model = fit(fitted, components)
    error = identity_error(model, fitted)
    told = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(e).cast("double").alias("explained")) for k, e in enumerate(model.explained())])
    if not model.roots:
        told = F.array().cast("array<struct<component:int,explained:double>>")
    found = transform(model, rows).withColumn("told", F.explode(told))
    return found.select(
        "id", "told.component", F.lit(model.n).cast("long").alias("n"), "deviation", F.get("whitened", F.col("told.component") - 1).alias("whitened"),
        "told.explained", F.lit(error).cast("double").alias("identity_error"))
