"""Print the formatted physical plan of registered queries.

usage: python scripts/explain.py [sf_dir] name [name ...]
"""
from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from hexlens.catalog import load_all  # noqa: E402
from hexlens.session import build_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", 8)
    reg = load_all()
    for name in names:
        print(f"===== {name}")
        reg[name].fn(spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
