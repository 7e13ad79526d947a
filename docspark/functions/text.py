"""Text and number formatting that agrees with JavaScript strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters JavaScript's trim removes.
JS_SPACE = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def js_trim(text: Column) -> Column:
    """Strip JavaScript white space at both ends (Spark's plain trim only strips spaces)."""
    return F.btrim(text, F.lit(JS_SPACE))


def js_number(number: Column) -> Column:
    """A number the way ``String(v)`` prints it: 30 and not 30.0, 1e+21, 1.5e-7.

    Text is read as a double first, so 1.1000000000000001 prints 1.1. The digits are
    the fewest that read back as the same double, and none is cut: from 1e-6 up to
    1e21 they stand around the point, beyond that with an exponent. Where 17 digits
    are needed, and for subnormal numbers, digits come from the Java runtime, whose
    last one may differ from JavaScript's by one. NULL where the input is no number.
    """
    double = number.try_cast("double")
    short = double.cast("string")
    # up to 15 digits around a point are the fewest; else 15, 16 or 17 are tried in turn
    simple = ~F.contains(short, F.lit("E")) & (F.length(short) <= 16)
    plain = F.when(short.endswith(".0"), F.left(short, F.length(short) - 2)).otherwise(short)
    tried = [F.format_string(f"%.{n}e", double) for n in (14, 15, 16)]
    fewest = F.coalesce(*[F.when(t.try_cast("double") == double, t) for t in tried], short)
    return F.when(double == 0, F.lit("0")).when(simple, plain).otherwise(_from_exponent(fewest))


def _from_exponent(text: Column) -> Column:
    """``-d.ddde+NN`` as JavaScript prints it; any other text, such as NaN, as it is."""
    pattern = r"^(-?)(\d)\.(\d+)e([+-]\d+)$"

    def split(t):
        digits = F.regexp_replace(F.concat(F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3)), "0+$", "")
        return F.struct(
            t.alias("text"),
            F.regexp_extract(t, pattern, 1).alias("sign"),
            digits.alias("digits"),
            # the value is 0.digits * 10^point
            (F.regexp_extract(t, pattern, 4).try_cast("int") + 1).alias("point"),
        )

    def put_together(x):
        digits, point, n = x["digits"], x["point"], F.length(x["digits"])
        rest = F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit("."), F.substr(digits, F.lit(2))))
        plus = F.when(point > 0, F.lit("e+")).otherwise(F.lit("e"))
        number = (
            F.when(
                (point > 21) | (point <= -6),
                F.concat(F.left(digits, F.lit(1)), rest, plus, (point - 1).cast("string")),
            )
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .when(point > 0, F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        )
        return F.when(point.isNull(), x["text"]).otherwise(F.concat(x["sign"], number))

    # arrays of one value, so that each step is worked out once
    return F.transform(F.transform(F.array(text), split), put_together)[0]
