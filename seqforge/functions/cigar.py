"""CIGAR algebra on arrays of (n, op), all within Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<n:int,op:string>>"
READ_OPS, REF_OPS = "M=XIS", "M=XDN"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty() -> Column:
    return F.array().cast(KIND)


def op(n, name) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    name = name if isinstance(name, Column) else F.lit(name)
    return F.struct(n.cast("int").alias("n"), name.alias("op"))


def parse(text: Column | str) -> Column:
    """Operations of a CIGAR string; none for * and the empty string."""
    found = lambda k: F.regexp_extract_all(_c(text), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(k))
    return F.zip_with(found(1), found(2), lambda n, o: op(n, o))


def render(ops: Column | str) -> Column:
    return F.array_join(F.transform(_c(ops), lambda o: F.concat(o["n"].cast("string"), o["op"])), "")


def append(ops: Column, o: Column) -> Column:
    """Add an operation; a run of the same kind grows instead."""
    last = F.try_element_at(ops, F.lit(-1))
    merged = F.concat(F.slice(ops, 1, F.size(ops) - 1), F.array(op(last["n"] + o["n"], o["op"])))
    return F.when(o["n"] == 0, ops).when((F.size(ops) > 0) & (last["op"] == o["op"]), merged).otherwise(F.concat(ops, F.array(op(o["n"], o["op"]))))


def concat(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(_c(b), _c(a).cast(KIND), append)


def normalised(ops: Column | str) -> Column:
    """Neighbouring runs of a kind merged, empty ones dropped."""
    return F.aggregate(_c(ops), empty(), append)


def m_form(ops: Column | str) -> Column:
    """= and X as M."""
    return normalised(F.transform(_c(ops), lambda o: op(o["n"], F.when(o["op"].isin("=", "X"), "M").otherwise(o["op"]))))


def total(ops: Column | str, kinds: str) -> Column:
    """Summed lengths of operations of these kinds."""
    return F.aggregate(F.filter(_c(ops), lambda o: o["op"].isin(*kinds)), F.lit(0).cast("long"), lambda t, o: t + o["n"])


def number(ops: Column | str, kinds: str) -> Column:
    return F.size(F.filter(_c(ops), lambda o: o["op"].isin(*kinds))).cast("long")


def distance(ops: Column | str) -> Column:
    """NM of an extended CIGAR: X, I and D."""
    return total(ops, "XID")


def reverse(ops: Column | str) -> Column:
    return F.reverse(_c(ops))


def read_length(ops: Column | str) -> Column:
    return total(ops, READ_OPS)


def reference_length(ops: Column | str) -> Column:
    return total(ops, REF_OPS)


def left_clip(ops: Column | str) -> Column:
    """Soft-clipped bases at the left end."""
    first = F.get(F.filter(_c(ops), lambda o: o["op"] != "H"), 0)
    return F.when(first["op"] == "S", first["n"]).otherwise(0).cast("long")


def unclipped(ops: Column | str) -> Column:
    """Without S and H."""
    return F.filter(_c(ops), lambda o: ~o["op"].isin("S", "H"))


def reclipped(inner: Column | str, clipped: Column | str) -> Column:
    """inner between the clips of clipped."""
    c = _c(clipped)
    n = F.size(c)
    body = F.transform(c, lambda o, i: F.struct(o.alias("o"), i.alias("i")))
    core = F.filter(body, lambda x: ~x["o"]["op"].isin("S", "H"))
    lo, hi = F.get(core, 0)["i"], F.try_element_at(core, F.lit(-1))["i"]
    left = F.slice(c, 1, F.coalesce(lo, n))
    right = F.when(hi.isNull() | (hi + 1 >= n), empty()).otherwise(F.slice(c, hi + 2, F.greatest(n - hi - 1, F.lit(0))))
    return F.concat(left, _c(inner), right)


def is_valid(ops: Column | str, length: Column | int, with_clips: bool = False) -> Column:
    """All lengths positive, and those of M and I (with_clips: S and H too) sum to length."""
    kinds = "MISH" if with_clips else "MI"
    return F.forall(_c(ops), lambda o: o["n"] > 0) & (total(ops, kinds) == length)


def trim_left(ops: Column | str, n: Column | int) -> Column:
    """Without the first n read bases; operations that only the reference has go with them."""
    n = F.lit(n) if isinstance(n, int) else n
    start = F.struct(n.cast("int").alias("todo"), empty().alias("out"))

    def step(s: Column, o: Column) -> Column:
        on_read = o["op"].isin(*READ_OPS)
        cut = F.when(on_read, F.least(s["todo"], o["n"])).otherwise(F.when(s["todo"] > 0, o["n"]).otherwise(0))
        left = F.when(on_read, s["todo"] - F.least(s["todo"], o["n"])).otherwise(s["todo"])
        return F.struct(left.cast("int").alias("todo"), append(s["out"], op(o["n"] - cut, o["op"])).alias("out"))

    return F.aggregate(_c(ops), start, step)["out"]


def trim_right(ops: Column | str, n: Column | int) -> Column:
    return reverse(trim_left(reverse(ops), n))


def trimmed_reference(ops: Column | str, n: Column | int) -> Column:
    """Reference bases that trim_left takes away."""
    return reference_length(ops) - reference_length(trim_left(ops, n))


def offsets(ops: Column | str) -> Column:
    """n, op, r and g: read and reference bases before each operation."""
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.array().cast("array<struct<n:int,op:string,r:int,g:int>>").alias("out"))

    def step(s: Column, o: Column) -> Column:
        row = F.struct(o["n"].alias("n"), o["op"].alias("op"), s["r"].alias("r"), s["g"].alias("g"))
        r = s["r"] + F.when(o["op"].isin(*READ_OPS), o["n"]).otherwise(0)
        g = s["g"] + F.when(o["op"].isin(*REF_OPS), o["n"]).otherwise(0)
        return F.struct(r.alias("r"), g.alias("g"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(_c(ops), start, step)["out"]


def projected(seq: Column | str, ops: Column | str) -> Column:
    """Read bases at reference positions: insertions and clips left out, deletions as -."""
    s = _c(seq)
    piece = lambda o: F.when(o["op"].isin("M", "=", "X"), F.substring(s, o["r"] + 1, o["n"])).when(o["op"].isin("D", "N"), F.repeat(F.lit("-"), o["n"])).otherwise("")
    return F.array_join(F.transform(offsets(ops), piece), "")


def projected_reference(seq: Column | str, ops: Column | str, reference: Column | str) -> Column:
    """A string as long as the read: reference where bases are aligned, the read itself at insertions and clips."""
    s, ref = _c(seq), _c(reference)
    piece = lambda o: F.when(o["op"].isin("M", "=", "X"), F.substring(ref, o["g"] + 1, o["n"])).when(o["op"].isin("I", "S"), F.substring(s, o["r"] + 1, o["n"])).otherwise("")
    return F.array_join(F.transform(offsets(ops), piece), "")
