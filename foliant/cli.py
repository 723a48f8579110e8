"""A prompt over an index: python -m foliant.cli INDEX [ROOT] [--stop-words FILE]."""

from __future__ import annotations

import argparse
import cmd
import contextlib
import logging
import os
import re

from pyspark.sql import SparkSession

from foliant.functions.stopwords import read_list
from foliant.operators.index import IndexInUse
from foliant.plans.engine import Engine
from foliant.streaming.control import MESSAGES

try:
    import readline
except ImportError:  # not on every system; the prompt does without
    readline = None

log = logging.getLogger("foliant")
STATS = ("base", "debug", "word", "writes", "problems")
# Commands: what follows them, and what they do.
COMMANDS = {
    "index": ("", "index new files below the root"),
    "find": ("GLOB...", "files with a word for every glob, and their matching lines"),
    "files": ("GLOB", "files whose names match"),
    "next": ("", "the next page of the last find"),
    "first": ("", "its first page again"),
    "delete": ("GLOB", "delete files from the index"),
    "summary": ("NUMBER", "accepted, does nothing"),
    "stats": ("base|debug|word WORD|writes|problems", "sizes and what runs; the dictionary; one word; batches; files passed over"),
    "store": ("[PATH]", "compact the index, or save a compacted copy"),
    "control": ("pause|resume|save|quit", "a message to streams that index, read between their batches"),
    "unlock": ("", "remove the lock that a dead application left"),
    "help": ("", "this text"),
    "quit": ("", "leave"),
}
HELP = "\n".join(f"{name} {rest}".ljust(46) + what for name, (rest, what) in COMMANDS.items())


class Wrong(ValueError):
    """A command that can't be understood from a place on."""

    def __init__(self, at: int, expected: str):
        super().__init__(expected)
        self.at, self.expected = at, expected


def arguments(line: str) -> list[tuple[int, str]]:
    """Parts between spaces and tabs, with their places."""
    return [(m.start(), m[0]) for m in re.finditer(r"[^ \t]+", line)]


class Prompt(cmd.Cmd):
    prompt = "> "

    def __init__(self, engine: Engine, history: str | None = None, **kw):
        super().__init__(**kw)
        self.engine, self.pager, self.history = engine, None, history

    def preloop(self) -> None:
        if readline and self.history and os.path.exists(self.history):
            readline.read_history_file(self.history)

    def postloop(self) -> None:
        if readline and self.history:
            readline.write_history_file(self.history)

    def say(self, text: object) -> None:
        self.stdout.write(f"{text}\n")

    def onecmd(self, line: str) -> bool:
        try:
            found = arguments(line)
            if found and found[0][1] == "?":
                found[0] = (found[0][0], "help")
            if found and found[0][1] not in (*COMMANDS, "EOF"):
                raise Wrong(found[0][0], f"unknown command: {found[0][1]}; one of " + ", ".join(self.completenames(found[0][1]) or COMMANDS))
            if not found:
                return False
            self.line = line
            return bool(getattr(self, f"do_{found[0][1]}")(found[1:]))
        except Wrong as e:
            self.say(line)
            self.say(" " * e.at + "^ " + e.expected)
        except IndexInUse as e:
            self.say(f"refused: {e}")
        except Exception as e:  # a prompt goes on
            log.exception("command failed: %s", line)
            self.say(f"error: {e}")
        return False

    def _one(self, args: list, expected: str) -> str:
        """The only argument."""
        if not args:
            raise Wrong(len(self.line), f"expected {expected}")
        if len(args) > 1:
            raise Wrong(args[1][0], "nothing more expected")
        return args[0][1]

    def _none(self, args: list) -> None:
        if args:
            raise Wrong(args[0][0], "nothing more expected")

    def _show(self, rows: list) -> None:
        start = (self.pager.at - 1) * self.pager.size
        for i, row in enumerate(rows, start):
            self.say(f"  {i}:{row['name']}")
            for text in row["lines"]:
                self.say(f"    {text}")
        if self.pager.has_more:
            self.say("...")

    def do_index(self, args: list) -> None:
        self._none(args)
        self.engine.index()

    def do_find(self, args: list) -> None:
        if not args:
            raise Wrong(len(self.line), "expected GLOB...")
        self.pager = self.engine.find_pages(*(a for _, a in args))
        self._show(self.pager.first())

    def do_first(self, args: list) -> None:
        self._none(args)
        if self.pager:
            self._show(self.pager.first())

    def do_next(self, args: list) -> None:
        self._none(args)
        if self.pager:
            self._show(self.pager.next())

    def do_files(self, args: list) -> None:
        glob = self._one(args, "GLOB")
        self.pager = None
        for i, row in enumerate(self.engine.find_files(glob).toLocalIterator()):
            self.say(f"  {i}:{row['name']}")

    def do_delete(self, args: list) -> None:
        self.engine.delete(self._one(args, "GLOB"))

    def do_stats(self, args: list) -> None:
        what = args[0][1] if args else "base"
        if what not in STATS:
            raise Wrong(args[0][0], "expected one of " + ", ".join(STATS))
        if what == "word":
            word = self._one(args[1:], "WORD")
            self.say(self.engine.posting_stats(word).first().asDict())
            return
        self._none(args[1:])
        if what == "base":
            self.say(self.engine.stats().first().asDict())
            for stream in self.engine.running():
                self.say(f"  running: {stream}")
            for step in list(self.engine.index_.steps)[-8:]:
                self.say(f"  done here: {step}")
            last = self.engine.write_stats().where("n_files > 0").orderBy("at", ascending=False).first()
            self.say(f"  last batch: {last.asDict() if last else None}")
        elif what == "debug":
            for row in self.engine.word_ids().orderBy("word").toLocalIterator():
                self.say(f"{row['word']}: [{row['word_id']}] n={row['count']} df={row['df']}")
        elif what == "writes":
            for row in self.engine.write_stats().collect():  # as many as there are batches
                self.say(row.asDict())
        else:
            for row in self.engine.problems().toLocalIterator():
                self.say(f"{row['name']}: {row['message']}")

    def do_store(self, args: list) -> None:
        self.engine.save(self._one(args, "PATH") if args else None)
        self.say("stored")

    def do_control(self, args: list) -> None:
        message = self._one(args, "|".join(MESSAGES))
        if message not in MESSAGES:
            raise Wrong(args[0][0], "expected one of " + ", ".join(MESSAGES))
        self.say(f"message {self.engine.control(message)}")

    def do_unlock(self, args: list) -> None:
        self._none(args)
        self.engine.unlock()

    def do_summary(self, args: list) -> None:
        if not self._one(args, "NUMBER").isdigit():
            raise Wrong(args[0][0], "expected NUMBER")

    def do_help(self, args: list) -> None:
        self.say(HELP)

    def do_quit(self, args: list) -> bool:
        return True

    do_EOF = do_quit

    # Completion and hints.

    def completenames(self, text: str, *_: object) -> list[str]:
        return [c for c in COMMANDS if c.startswith(text)]

    def complete_stats(self, text: str, *_: object) -> list[str]:
        return [w for w in STATS if w.startswith(text)]

    def complete_control(self, text: str, *_: object) -> list[str]:
        return [w for w in MESSAGES if w.startswith(text)]

    def completedefault(self, text: str, line: str, *_: object) -> list[str]:
        """Nothing to complete: show what may follow instead."""
        if what := self.hint(line):
            self.stdout.write(f"\n{what}\n{self.prompt}{line}")
            self.stdout.flush()
        return []

    def hint(self, line: str) -> str:
        """What may follow a line: the rest of a command that is the only one to begin so, or its arguments."""
        found = arguments(line)
        if len(found) == 1 and not line.endswith((" ", "\t")):
            names = self.completenames(found[0][1])
            return names[0][len(found[0][1]) :] if len(names) == 1 else ""
        if len(found) == 1:
            return COMMANDS.get(found[0][1], ("",))[0]
        return ""


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("index")
    args.add_argument("root", nargs="?", default=".")
    args.add_argument("--stop-words")
    args.add_argument("--log", default="log.txt")
    args.add_argument("--history", default="history.txt")
    a = args.parse_args()
    logging.basicConfig(filename=a.log, level=logging.INFO)
    spark = SparkSession.builder.appName("foliant").getOrCreate()
    with contextlib.suppress(KeyboardInterrupt):
        Prompt(Engine(spark, a.index, a.root, read_list(a.stop_words) if a.stop_words else None), a.history).cmdloop()


if __name__ == "__main__":
    main()
