"""python -m lafzspark COMMAND: the column functions on lines of text.

Commands: to-urdu, to-roman, normalize, words, numbers. Lines come from arguments, -i FILE or standard input and go to standard
output, or to -o FOLDER as Spark writes it. Exit codes: 1 for an input that can't be read, 130 after an interrupt.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lafzspark.functions import letters, numbers
from lafzspark.functions import text as T
from lafzspark.sources.texts import InputError, decoded_lines, looks_mangled, read_lines, write_lines


def commands(args: argparse.Namespace) -> dict[str, tuple[Column, str]]:
    """A column of results and its name by command."""
    line = F.col("line")
    urdu = letters.transliterate(line, urdu_punctuation=not args.latin_punctuation)
    return {
        "to-urdu": (urdu if args.sources else urdu["text"], "urdu"),
        "to-roman": (letters.rules_to_roman(line) if args.method == "rules" else letters.to_roman(line), "roman"),
        "normalize": (T.normalize(line, digits=args.digits, punctuation=args.punctuation), "text"),
        "words": (T.words(line), "words"),
        "numbers": (numbers.find_numbers(line), "numbers"),
    }


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lafzspark", description=__doc__.splitlines()[0])
    p.add_argument("command", choices=["to-urdu", "to-roman", "normalize", "words", "numbers"])
    p.add_argument("text", nargs="*")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("--encoding")
    p.add_argument("--json", action="store_true")
    p.add_argument("--sources", action="store_true")
    p.add_argument("--latin-punctuation", action="store_true")
    p.add_argument("--method", choices=["curated", "rules"], default="curated")
    p.add_argument("--digits", action="store_true")
    p.add_argument("--punctuation", action="store_true")
    return p


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> None:
    if args.text:
        lines = spark.createDataFrame([(" ".join(args.text),)], "line string")
    elif args.input:
        lines = read_lines(spark, args.input, args.encoding)
    else:
        lines = spark.createDataFrame([(x,) for x in decoded_lines(sys.stdin.buffer.read(), "standard input", args.encoding)], "line string")
    value, name = commands(args)[args.command]
    if args.json:
        shown = F.to_json(F.struct(F.col("line").alias("input"), value.alias(name)))
    else:
        shown = F.array_join(value, " ") if args.command == "words" else F.to_json(value) if args.command == "numbers" or (args.command == "to-urdu" and args.sources) else value
    if args.output:
        write_lines(lines.select(shown.alias("line")), "line", args.output)
        return
    for row in lines.select(shown.alias("shown"), looks_mangled(F.col("line")).alias("mangled")).toLocalIterator():
        if row["mangled"]:
            print("warning: a line of question marks: was the text mangled on its way?", file=sys.stderr)
        print(row["shown"], file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_intermixed_args(argv)
    spark = SparkSession.builder.appName("lafzspark").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        run(spark, args)
    except KeyboardInterrupt:
        return 130
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    except InputError as error:
        print(f"lafzspark: {error}", file=sys.stderr)
        return 1
    except Exception as error:
        if "InputError" not in str(error) and "PATH_NOT_FOUND" not in str(error):
            raise
        print(f"lafzspark: {next((x for x in str(error).splitlines() if 'InputError' in x), str(error).splitlines()[0])}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
