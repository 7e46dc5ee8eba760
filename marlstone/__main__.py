"""python -m marlstone sql [-e TEXT | -f FILE] [--format table|csv|json] [--data FOLDER]; python -m marlstone serve [--port N]."""

from __future__ import annotations

import argparse
import sys


def statements_of(text: str) -> list[str]:
    """Statements of a script, parted by semicolons outside quotes and comments."""
    out, now, quote, k = [], [], None, 0
    while k < len(text):
        c = text[k]
        if quote:
            now.append(c)
            if c == "\\" and quote != "`" and k + 1 < len(text):
                k += 1
                now.append(text[k])
            elif c == quote:
                quote = None
        elif text.startswith("--", k):
            k = text.find("\n", k) if "\n" in text[k:] else len(text)
            continue
        elif c == ";":
            out.append("".join(now))
            now = []
        else:
            quote = c if c in "'\"`" else None
            now.append(c)
        k += 1
    return [s for s in (x.strip() for x in [*out, "".join(now)]) if s]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marlstone")
    commands = parser.add_subparsers(dest="command", required=True)
    sql = commands.add_parser("sql")
    sql.add_argument("-e", "--execute")
    sql.add_argument("-f", "--file")
    sql.add_argument("--format", choices=("table", "csv", "json"), default="table")
    sql.add_argument("--data", help="a folder whose tables become views")
    sql.add_argument("--rows", type=int, default=1000, help="rows shown of each result")
    http = commands.add_parser("serve")
    http.add_argument("--port", type=int, default=8080)
    args = parser.parse_args(argv)

    from marlstone.session import session

    spark = session("marlstone")
    if args.command == "serve":
        from marlstone.services.http import serve

        serve(spark, port=args.port).serve_forever()
        return 0
    if args.data:
        from marlstone.sources.readers import register_samples

        register_samples(spark, args.data)
    if args.execute is not None:
        text = args.execute
    else:
        text = open(args.file).read() if args.file else sys.stdin.read()
    for statement in statements_of(text):
        df = spark.sql(statement)
        if not df.columns:
            continue
        if args.format == "table":
            print(df._show_string(args.rows, 0, False), end="")
            continue
        frame = df.limit(args.rows).toPandas()
        print(frame.to_csv(index=False) if args.format == "csv" else frame.to_json(orient="records", lines=True, date_format="iso"), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
