"""Shell text: three tokenizers, a splitter into simple commands, wrapper stripping.

The three tokenizers differ on purpose: history files, the correlator and rule matching
each read commands their own way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.functions.shapes import INT, STRING, array, struct

#: Shells, wrappers with the flags that take the next word, positionals before the command.
SHELLS = frozenset("sh bash zsh dash ksh fish ash".split())
WRAPPERS = {
    "sudo": frozenset("-u -g -C -D -h -p -r -t -U -T --user --group --prompt --host --chdir --role --type".split()),
    "doas": frozenset("-u -C".split()),
    "env": frozenset("-u -C -S --unset --chdir --split-string".split()),
    "nice": frozenset("-n --adjustment".split()),
    "time": frozenset("-f -o --format --output".split()),
    "timeout": frozenset("-s -k --signal --kill-after".split()),
    "xargs": frozenset("-n -I -P -d -a -L -s -E -i -l --max-args --replace --max-procs --delimiter --arg-file --max-lines --max-chars --eof".split()),
    "command": frozenset(),
    "nohup": frozenset(),
    "exec": frozenset(["-a"]),
    "builtin": frozenset(),
}
POSITIONALS = {"timeout": 1}
#: Fixed value: global options whose value is the next word.
VALUE_OPTIONS = frozenset("-C -c -chdir -namespace -profile --config --context --chdir --cwd --directory --namespace -n --profile --region --kubeconfig --host -H".split())
DEEPEST = 16

# --- history and correlator tokenizers ---------------------------------------------------

_HISTORY = re.compile(
    r"""(?P<word>(?:[^\s"'\\|;&]|&(?!&)|\\.|\\$|"(?:[^"\\]|\\.)*(?:"|\\?$)|'[^']*(?:'|$))+)|(?P<cut>&&|\|\||\||;)|[ \t\r\n]+|.""",
    re.DOTALL,
)
_PIECE = re.compile(r"""\\(?P<esc>.)|\\$|"(?P<dq>(?:[^"\\]|\\.)*)(?:"|\\?$)|'(?P<sq>[^']*)(?:'|$)|(?P<raw>[^"'\\]+)""", re.DOTALL)


def _unquoted(word: str) -> str:
    def piece(m: re.Match) -> str:
        if m["dq"] is not None:
            return re.sub(r"\\(.)", r"\1", m["dq"], flags=re.DOTALL)
        return m["esc"] or m["sq"] or m["raw"] or ""

    return _PIECE.sub(piece, word)


def stages(command: str) -> list[list[str]]:
    """A history line as one argv per stage; | || && ; separate, quotes and escapes are honoured."""
    out: list[list[str]] = [[]]
    for m in _HISTORY.finditer(command):
        if m["cut"]:
            out.append([])
        elif m["word"] and (word := _unquoted(m["word"])):
            out[-1].append(word)
    return [s for s in out if s]


def correlator_words(command: str) -> list[str]:
    """Words parted by spaces outside quotes; quotes vanish and nothing is an escape."""
    out = re.findall(r"""(?:[^ "']|"[^"]*(?:"|$)|'[^']*(?:'|$))+""", command)
    strip = lambda w: re.sub(r""""([^"]*)(?:"|$)|'([^']*)(?:'|$)""", lambda m: m[1] or m[2] or "", w)
    return [w for w in map(strip, out) if w]


def quoted(argv: list[str]) -> str:
    """An argv as one line, words with special characters in single quotes."""
    return " ".join("'" + a.replace("'", "'\\''") + "'" if re.search(r"""[\s|&;$"'\\]""", a) else a for a in argv)


# --- the splitter ------------------------------------------------------------------------


@dataclass(frozen=True)
class Command:
    argv: list[str]
    raw_argv: list[str]
    origin: str
    wrappers: list[str] = field(default_factory=list)
    idx: int = 0


_REDIRECT = re.compile(r"&>>|&>|<<<|<<-|<<|<>|<&|>>|>&|>\||<(?!\()|>(?!\()")
_LIST = re.compile(r"&&|\|\||\|&|;;|[;|&\n]")
_PLAIN = re.compile(r"""[^\s"'\\`$();|&<>#{}]+""")


class _Splitter:
    """One pass over the text; a command inside another comes out before it."""

    def __init__(self, text: str, origin: str):
        self.text, self.origin, self.at = text, origin, 0
        self.out: list[Command] = []
        self.argv: list[str] = []
        self.word: list[str] | None = None
        self.skip_word = False  # the next word is where a redirection goes
        self.heredocs: list[tuple[str, bool]] = []

    def add(self, piece: str) -> None:
        self.word = [*(self.word or []), piece]

    def end_word(self) -> None:
        if self.word is None:
            return
        word, self.word = "".join(self.word), None
        if self.skip_word:
            self.skip_word = False
        else:
            self.argv.append(word)

    def end_command(self) -> None:
        self.end_word()
        self.skip_word = False
        if self.argv:
            self.out.append(Command(self.argv, self.argv, self.origin))
        self.argv = []

    def inner(self, text: str, origin: str) -> None:
        self.out += _Splitter(text, origin).run()

    def closing(self, at: int, close: str) -> int:
        """Where the bracket that was opened before `at` closes, or the end of the text."""
        depth, opening = 1, {")": "(", "}": "{"}.get(close, "")
        while at < len(self.text):
            c = self.text[at]
            if c == "\\":
                at += 1
            elif c == "'" and close != "`":
                at = self.text.find("'", at + 1)
                if at < 0:
                    break
            elif c == '"' and close != "`":
                at = self.quote_end(at + 1)
            elif c == close:
                depth -= 1
                if not depth:
                    return at
            elif c == opening:
                depth += 1
            at += 1
        return len(self.text)

    def quote_end(self, at: int) -> int:
        while at < len(self.text) and self.text[at] != '"':
            if self.text[at] == "\\":
                at += 1
            elif self.text.startswith("$(", at):
                at = self.closing(at + 2, ")")
            at += 1
        return at

    def substitution(self) -> None:
        """$(...), ${...}, $((...)) or `...` at the current place: kept as text, its commands first."""
        start = self.at
        if self.text[start] == "`":
            end = self.closing(start + 1, "`")
            self.inner(self.text[start + 1 : end].replace("\\`", "`"), "substitution")
        elif self.text.startswith("$((", start):
            end = self.closing(start + 2, ")")
        elif self.text.startswith("$(", start):
            end = self.closing(start + 2, ")")
            self.inner(self.text[start + 2 : end], "substitution")
        else:
            end = self.closing(start + 2, "}")
        self.at = min(end + 1, len(self.text))
        self.add(self.text[start : self.at])

    def double_quoted(self) -> None:
        self.at += 1
        self.add("")
        while self.at < len(self.text) and (c := self.text[self.at]) != '"':
            if c == "\\" and self.at + 1 < len(self.text):
                follows = self.text[self.at + 1]
                self.add(follows if follows in '"\\$`' else "" if follows == "\n" else c + follows)
                self.at += 2
            elif c == "`" or self.text.startswith(("$(", "${"), self.at):
                self.substitution()
            else:
                self.add(c)
                self.at += 1
        self.at += 1

    def heredoc_name(self) -> str:
        m = re.compile(r"""[ \t]*((?:'[^']*'?|"[^"]*"?|\\.|[^\s;&|<>()'"\\])*)""", re.DOTALL).match(self.text, self.at)
        self.at = m.end()
        return re.sub(r"""\\(.)|['"]""", lambda q: q[1] or "", m[1])

    def heredoc_bodies(self) -> None:
        for name, tabs in self.heredocs:
            while self.at < len(self.text):
                end = self.text.find("\n", self.at)
                end = len(self.text) if end < 0 else end
                line = self.text[self.at : end]
                self.at = min(end + 1, len(self.text))
                if (line.lstrip("\t") if tabs else line) == name:
                    break
        self.heredocs = []

    def redirect(self, op: str) -> None:
        if self.word is not None and "".join(self.word).isdigit():
            self.word = None  # the descriptor belongs to the redirection
        else:
            self.end_word()
        self.at += len(op)
        if op in ("<<", "<<-"):
            if name := self.heredoc_name():
                self.heredocs.append((name, op == "<<-"))
        else:
            self.skip_word = True

    def run(self) -> list[Command]:
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            if m := _PLAIN.match(text, self.at):
                self.add(m[0])
                self.at = m.end()
            elif m := _REDIRECT.match(text, self.at):
                self.redirect(m[0])
            elif m := _LIST.match(text, self.at):
                self.end_command()
                self.at = m.end()
                if m[0] == "\n" and self.heredocs:
                    self.heredoc_bodies()
            elif c.isspace():
                self.end_word()
                self.at += 1
            elif c == "#" and self.word is None:
                end = text.find("\n", self.at)
                self.at = len(text) if end < 0 else end
            elif c == "'":
                end = text.find("'", self.at + 1)
                end = len(text) if end < 0 else end
                self.add(text[self.at + 1 : end])
                self.at = end + 1
            elif c == '"':
                self.double_quoted()
            elif c == "\\":
                if text[self.at + 1 : self.at + 2] != "\n":
                    self.add(text[self.at + 1 : self.at + 2])
                self.at += 2
            elif c == "`" or text.startswith(("$(", "${"), self.at):
                self.substitution()
            elif c in "<>":  # <( or >(
                end = self.closing(self.at + 2, ")")
                self.inner(text[self.at + 2 : end], "substitution")
                self.add(text[self.at : end + 1])
                self.at = end + 1
            elif c == "(":
                self.end_command()
                end = self.closing(self.at + 1, ")")
                self.inner(text[self.at + 1 : end], "subshell")
                self.at = end + 1
            elif c in "{}" and self.word is None and not self.argv and text[self.at + 1 : self.at + 2] in ("", " ", "\t", "\n", ";", "&", "|", ")"):
                self.at += 1
            elif c == ")":
                self.end_command()
                self.at += 1
            else:
                self.add(c)
                self.at += 1
        self.end_command()
        return self.out


def split(text: str, origin: str = "top") -> list[Command]:
    """The simple commands of a compound command, without redirections, comments and heredoc bodies."""
    return _Splitter(text, origin).run()


# --- wrappers ----------------------------------------------------------------------------

_ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")


def _flags(words: list[str], valued: frozenset[str]) -> int:
    """How many leading words are a wrapper's own flags and their values."""
    at = 0
    while at < len(words):
        word = words[at]
        if word == "--":
            return at + 1
        if len(word) < 2 or word[0] != "-":
            break
        inline = "=" in word or (not word.startswith("--") and len(word) > 2 and word[:2] in valued)
        at += 2 if word in valued and not inline else 1
    return at


def _shell_text(argv: list[str]) -> str | None:
    """The command text of `shell [flags] -c text`."""
    for at, word in enumerate(argv[1:], 1):
        if not word.startswith("-") or word.startswith("--"):
            return None
        if "c" in word:
            return argv[at + 1] if at + 1 < len(argv) else None
    return None


def stripped(command: Command) -> list[Command]:
    """A command without assignments and wrappers; several when it is a shell with -c."""
    argv, wrappers = command.argv, []
    for _ in range(DEEPEST):
        while argv and (m := _ASSIGNMENT.match(argv[0])):
            wrappers.append(m[0])
            argv = argv[1:]
        if not argv:
            break
        verb = argv[0].rpartition("/")[2]
        if verb in SHELLS:
            text = _shell_text(argv)
            if text is None:
                break
            return [replace(c, wrappers=[*wrappers, verb, *c.wrappers]) for part in split(text, "shell-c") for c in stripped(part)]
        if verb not in WRAPPERS or (verb == "command" and {"-v", "-V"} & set(argv[1:])):
            break
        wrappers.append(verb)
        argv = argv[1 + _flags(argv[1:], WRAPPERS[verb]) + POSITIONALS.get(verb, 0) :]
    return [replace(command, argv=argv, wrappers=wrappers)]


def _numbered(commands: list[Command]) -> list[Command]:
    return [replace(c, idx=i) for i, c in enumerate(commands)]


def expand_text(text: str) -> list[Command]:
    """Every simple command that a command line runs, as far as its text shows."""
    return _numbered([c for part in split(text) for c in stripped(part)])


def expand_argv(argv: list[str]) -> list[Command]:
    return _numbered(stripped(Command(list(argv), list(argv), "top"))) if argv else []


def without_global_options(argv: list[str]) -> list[str]:
    """argv without the options that stand between the program and its subcommand."""
    at = 1
    while at < len(argv) and argv[at].startswith("-"):
        takes = argv[at] in VALUE_OPTIONS and at + 1 < len(argv) and not argv[at + 1].startswith("-")
        at += 2 if takes else 1
    return argv[:1] + argv[at:] if at > 1 else argv


# --- as Spark functions ------------------------------------------------------------------

COMMANDS = array(struct(idx=INT, argv=array(STRING), bare_argv=array(STRING), raw_argv=array(STRING), wrappers=array(STRING), origin=STRING))


def _rows(commands: list[Command]) -> list[dict]:
    return [{"idx": c.idx, "argv": c.argv, "bare_argv": without_global_options(c.argv), "raw_argv": c.raw_argv, "wrappers": c.wrappers, "origin": c.origin} for c in commands]


@F.pandas_udf(COMMANDS)
def text_commands(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _rows(expand_text(t)) if t is not None else [])


@F.pandas_udf(COMMANDS)
def argv_commands(argv: pd.Series) -> pd.Series:
    return argv.map(lambda a: _rows(expand_argv([x for x in a if x is not None])) if a is not None else [])


@F.pandas_udf(array(array(STRING)))
def history_stages(command: pd.Series) -> pd.Series:
    return command.map(lambda c: stages(c) if c is not None else [])


@F.pandas_udf(array(STRING))
def words(command: pd.Series) -> pd.Series:
    return command.map(lambda c: correlator_words(c) if c is not None else [])


@F.pandas_udf(STRING)
def command_line(argv: pd.Series) -> pd.Series:
    return argv.map(lambda a: quoted(list(a)) if a is not None else None)
