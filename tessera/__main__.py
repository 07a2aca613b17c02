"""Command line: run a script, or read statements and dot commands."""

from __future__ import annotations

import argparse
import sys
import tempfile
import time

from pyspark.sql import DataFrame

from tessera.engine import Connection, Database
from tessera.session import build

HELP = ".help .tables .schema [table] .indices [table] .timer on|off .quit .exit"


class Shell:
    def __init__(self, connection: Connection):
        self.c, self.timer, self.done = connection, False, False

    def line(self, text: str) -> str:
        """The answer to a line; errors are answers too."""
        began = time.perf_counter()
        try:
            if text.upper() in ("EXIT", "QUIT"):
                text = ".exit"
            out = self.dot(text) if text.startswith(".") else self.show(self.c.execute(text))
        except Exception as e:  # the shell goes on
            return f"Error: {str(e).splitlines()[0]}"
        return out + (f"\n{(time.perf_counter() - began) * 1000:.1f} ms" if self.timer else "")

    @staticmethod
    def show(result) -> str:
        if not isinstance(result, DataFrame):
            return result.message
        return result._show_string(1000, 50, False).rstrip()

    def dot(self, text: str) -> str:
        name, *args = text.split()
        tables = self.c.tables()
        picked = [tables[a] for a in args if a in tables] or list(tables.values())
        if name in (".quit", ".exit"):
            self.done = True
            return ""
        if name == ".timer":
            self.timer = args == ["on"]
            return f"timer {'on' if self.timer else 'off'}"
        if name == ".tables":
            return "\n".join(sorted(tables))
        if name == ".schema":
            return "\n".join(f"{t.name}: " + ", ".join(f"{c.name} {c.type.simpleString()}" for c in t.columns) for t in picked)
        if name == ".indices":
            return "\n".join(f"{i} on {t.name} ({c}){' unique' * u}" for t in picked for i, c, u in t.indexes)
        if name == ".help":
            return HELP
        raise ValueError(f"unknown command {name}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--file", "-f", help="run the statements of this file")
    p.add_argument("--folder", help="where tables are kept", default=None)
    p.add_argument("--version", action="version", version="0.1")
    args = p.parse_args(argv)
    spark = build("local[*]")
    shell = Shell(Database(spark, args.folder or tempfile.mkdtemp(prefix="tessera-")).connect())
    if args.file:
        for result in shell.c.run_script(open(args.file).read()):
            print(shell.show(result))
        return 0
    for line in sys.stdin:
        print(shell.line(line.strip().rstrip(";")) if line.strip() else "")
        if shell.done:
            break
    return 0


if __name__ == "__main__":
    sys.exit(main())
