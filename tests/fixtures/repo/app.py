"""Entry of the sample."""
from pkg.shapes import Square, area_of
import pkg.helpers as helpers


def main():
    shape = Square(3)
    total = area_of(shape)
    return helpers.report(total)


def unused(a, b, c, d, e, f):
    if a and b:
        return [x for x in c if x]
    return d


def again(n):
    return again(n - 1) if n else 0
