"""Statistics of the last w rows, wider windows put together from narrower ones.

The sum of the last 60 rows is that of the last 30 and that of the 30 before; so only the narrowest width slides over its
rows, and every further width costs a lag and an addition, whatever its length. Sums of squared, cubed and fourth-power
deviations and co-moments are joined by the pairwise update formulas, which lose no precision to the level of the values. How
many of the last rows are smaller or larger is counted over lags, made once for all widths. All steps share the symbol's partition
and order: no further exchange or sort.

A window with fewer than w values that are there is null, since its parts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xpanel.functions.exprs import back, correlation, full, rows

#: width: (its recent part, the part before), narrow ones first.
JOINS = {10: (5, 5), 15: (5, 10), 20: (10, 10), 30: (10, 20), 60: (30, 30)}
BASE = 5


class Rolling:
    """Collects what factor expressions need, then adds it to a frame: make the expressions, call add(), use the expressions."""

    def __init__(self) -> None:
        self.inputs: dict[str, Column] = {}
        self.needs: dict[tuple[str, tuple[str, ...]], set[int]] = {}
        self.direct: dict[str, Column] = {}

    # --- what expressions ask for

    def _value(self, kind: str, names: tuple[str, ...], w: int) -> Column:
        widths = self.needs.setdefault((kind, names), set())
        todo = [w]
        while todo:
            x = todo.pop()
            if x not in widths:
                widths.add(x)
                todo += JOINS.get(x, ())
        return F.col(self._name(kind, names, w))

    @staticmethod
    def _name(kind: str, names: tuple[str, ...], w: int) -> str:
        return f"_{kind}_{'_'.join(names)}_{w}"

    def _input(self, name: str, x: Column | None) -> Column:
        self.inputs.setdefault(name, F.col(name) if x is None else x)
        return F.col(f"_in_{name}")

    def _other_width(self, kind: str, name: str, w: int, value: Column) -> Column:
        self.direct[self._name(kind, (name,), w)] = value
        return F.col(self._name(kind, (name,), w))

    def total(self, name: str, w: int, x: Column | None = None) -> Column:
        """The sum of x (a column of that name if not given; a name stands for one x)."""
        value = self._input(name, x)
        return self._value("sum", (name,), w) if w == BASE or w in JOINS else self._other_width("sum", name, w, full(value, w, F.sum(value)))

    def mean(self, name: str, w: int, x: Column | None = None) -> Column:
        return self.total(name, w, x) / F.lit(float(w))

    def highest(self, name: str, w: int, x: Column | None = None) -> Column:
        self._input(name, x)
        return self._value("max", (name,), w)

    def lowest(self, name: str, w: int, x: Column | None = None) -> Column:
        self._input(name, x)
        return self._value("min", (name,), w)

    def squares(self, name: str, w: int, x: Column | None = None) -> Column:
        """The sum of squared deviations from the window's mean."""
        self.total(name, w, x)
        return self._value("m2", (name,), w)

    def cubes(self, name: str, w: int, x: Column | None = None) -> Column:
        """The sum of cubed deviations from the window's mean."""
        self.squares(name, w, x)
        return self._value("m3", (name,), w)

    def fourths(self, name: str, w: int, x: Column | None = None) -> Column:
        """The sum of fourth powers of the deviations from the window's mean."""
        self.cubes(name, w, x)
        return self._value("m4", (name,), w)

    def places(self, name: str, w: int, x: Column | None = None) -> tuple[Column, Column]:
        """How many of the w - 1 rows before are smaller, and larger, than this one."""
        now, smaller, larger = self._input(name, x), F.lit(0), F.lit(0)
        for k in range(1, w):
            self.direct.setdefault(f"_lag_{name}_{k}", back(now, k))
            smaller = smaller + (F.col(f"_lag_{name}_{k}") < now).cast("int")
            larger = larger + (F.col(f"_lag_{name}_{k}") > now).cast("int")
        return smaller, larger

    def std(self, name: str, w: int, x: Column | None = None) -> Column:
        return F.sqrt(self.squares(name, w, x) / F.lit(float(w - 1)))

    def products(self, a: str, b: str, w: int) -> Column:
        """The sum of products of the deviations of two inputs."""
        self.total(a, w)
        self.total(b, w)
        return self._value("cm", (a, b), w)

    def correlation(self, a: str, b: str, w: int, xa: Column | None = None, xb: Column | None = None) -> Column:
        """Pearson correlation; null where a side is constant."""
        va, vb = self._input(a, xa), self._input(b, xb)
        if w != BASE and w not in JOINS:
            return self._other_width("corr", f"{a}_{b}", w, correlation(va, vb, w))
        return F.try_divide(self.products(a, b, w), F.sqrt(self.squares(a, w)) * F.sqrt(self.squares(b, w)))

    # --- how it is made

    def _base(self, kind: str, names: tuple[str, ...]) -> Column:
        if kind in ("m3", "m4"):
            values = [F.col(f"_in_{names[0]}"), *[back(f"_in_{names[0]}", k) for k in range(1, BASE)]]
            apart = [v - sum(values[1:], values[0]) / F.lit(float(BASE)) for v in values]
            powers = [a * a * a if kind == "m3" else a * a * a * a for a in apart]
            return sum(powers[1:], powers[0])
        x = [F.col(f"_in_{n}") for n in names]
        both = x[0] if len(x) == 1 else F.when(x[0].isNotNull() & x[1].isNotNull(), x[0])
        value = {"sum": F.sum, "max": F.max, "min": F.min, "m2": lambda v: F.var_pop(v), "cm": lambda *v: F.covar_pop(*v)}[kind](*x)
        made = F.when(F.count(both).over(rows(BASE)) == BASE, value.over(rows(BASE)))
        return made * F.lit(float(BASE)) if kind in ("m2", "cm") else made

    def _joined(self, kind: str, names: tuple[str, ...], w: int) -> Column:
        recent, older = JOINS[w]
        part = lambda k, n: (F.col(self._name(k, n, recent)), back(self._name(k, n, older), recent))
        a, b = part(kind, names)
        if kind == "sum":
            return a + b
        if kind in ("max", "min"):
            return F.when(a.isNotNull() & b.isNotNull(), (F.greatest if kind == "max" else F.least)(a, b))
        if kind in ("m3", "m4"):
            return self._higher(kind, names, recent, older, a, b, part)
        apart = lambda n: (lambda s: s[0] / F.lit(float(recent)) - s[1] / F.lit(float(older)))(part("sum", (n,)))
        return a + b + apart(names[0]) * apart(names[-1]) * F.lit(recent * older / w)

    @staticmethod
    def _higher(kind: str, names: tuple[str, ...], na: int, nb: int, a: Column, b: Column, part) -> Column:
        """Third and fourth moments of two parts together."""
        sums, squares, n = part("sum", names), part("m2", names), na + nb
        d = sums[1] / F.lit(float(nb)) - sums[0] / F.lit(float(na))
        if kind == "m3":
            return a + b + d * d * d * F.lit(na * nb * (na - nb) / n**2) + d * (squares[1] * F.lit(float(na)) - squares[0] * F.lit(float(nb))) * F.lit(3 / n)
        cubes = part("m3", names)
        spread = d * d * d * d * F.lit(na * nb * (na**2 - na * nb + nb**2) / n**3)
        second = d * d * (squares[1] * F.lit(float(na**2)) + squares[0] * F.lit(float(nb**2))) * F.lit(6 / n**2)
        return a + b + spread + second + d * (cubes[1] * F.lit(float(na)) - cubes[0] * F.lit(float(nb))) * F.lit(4 / n)

    def add(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({f"_in_{n}": x for n, x in self.inputs.items()})
        df = df.withColumns({self._name(k, n, BASE): self._base(k, n) for (k, n), widths in self.needs.items() if BASE in widths} | self.direct)
        for w in JOINS:
            made = {self._name(k, n, w): self._joined(k, n, w) for (k, n), widths in self.needs.items() if w in widths}
            df = df.withColumns(made) if made else df
        return df

    def columns(self) -> list[str]:
        return [f"_in_{n}" for n in self.inputs] + [self._name(k, n, w) for (k, n), widths in self.needs.items() for w in widths] + list(self.direct)
