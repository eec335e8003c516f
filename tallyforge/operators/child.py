"""Programs' calls in one interpreter. `programs.run_blocks` starts this file's text in a process of its own, which reads jobs and writes results as JSON.

Every call runs the whole program in a new namespace. A program that can't leave anything behind but in its namespace shares one fork for its calls; another, and a call
that its fork doesn't survive, gets a fork of its own. It imports nothing of the package: the interpreter is isolated.
"""

import ast
import json
import os
import select
import signal
import sys
import traceback

#: Modules whose use leaves nothing behind.
STATELESS = {"typing", "math", "itertools", "functools", "collections", "string", "operator", "heapq", "bisect", "fractions", "statistics", "__future__"}
FAILED = ("Traceback (most recent call last):", "  File ")


def keeps_to_itself(code: str) -> bool:
    """True if the program imports stateless modules only, sets no attribute of theirs and names nothing that reaches around that."""
    try:
        nodes = list(ast.walk(ast.parse(code)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    imports = [n for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom))]
    modules = [m for n in imports for m in ([a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or "."])]
    names = {n.id for n in nodes if isinstance(n, ast.Name)} | {n.attr for n in nodes if isinstance(n, ast.Attribute)}
    stores = any(isinstance(n, ast.Attribute) and not isinstance(n.ctx, ast.Load) for n in nodes) and imports
    return not stores and all(m.split(".")[0] in STATELESS for m in modules) and not names & {"exec", "eval", "compile", "open", "setattr", "delattr", "breakpoint", "vars", "globals"} and not any(x.startswith("__") and x != "__result__" for x in names)


def ran(source: str) -> int:
    """The status that a fresh interpreter would end the program with, on the streams as they are. Threads still running and exit handlers are dropped."""
    status, depth, frame = 0, 0, sys._getframe()
    while frame:
        depth, frame = depth + 1, frame.f_back
    sys.setrecursionlimit(1000 + depth)
    try:
        exec(compile(source, "<string>", "exec"), {"__name__": "__main__", "__builtins__": __builtins__})  # noqa: S102
    except SystemExit as e:
        status = e.code if isinstance(e.code, int) else int(e.code is not None)
        if isinstance(e.code, str):
            print(e.code, file=sys.stderr)
    except BaseException as e:  # noqa: BLE001  printed like the interpreter does, without this file's frame
        status = 1
        traceback.print_exception(type(e), e, e.__traceback__.tb_next)
    sys.stdout.flush()
    sys.stderr.flush()
    return status & 255


def forked(work) -> tuple[int, list[int]]:
    """A fork of its own session that does the work, with files as output streams: its id and the files."""
    files = [os.memfd_create(name) for name in ("out", "err")]
    pid = os.fork()
    if pid:
        return pid, files
    status = 1
    try:
        os.setsid()
        for fd, file in zip((1, 2), files):
            os.dup2(file, fd)
        status = work()
    finally:
        os._exit(status)


def text(fd: int) -> str:
    return os.pread(fd, os.lseek(fd, 0, os.SEEK_END), 0).decode(errors="replace")


def ended(pid: int) -> int:
    """Its status, after what it has left running is gone."""
    for kill in (os.killpg, os.kill):
        try:
            kill(pid, signal.SIGKILL)
        except OSError:
            pass
    return os.waitpid(pid, 0)[1]


def alone(source: str, timeout: float) -> list:
    """[late, passed, stdout, stderr] of a fork of its own."""
    pid, files = forked(lambda: ran(source))
    watch = os.pidfd_open(pid)
    late = not select.select([watch], [], [], timeout)[0]
    passed = ended(pid) == 0 and not late
    found = [late, passed, *("" if late else text(fd) for fd in files)]
    for fd in (watch, *files):
        os.close(fd)
    return found


def together(sources: list, to: int) -> int:
    """Writes a line with the result of each source, one after another."""
    for source in sources:
        for fd in (1, 2):
            os.ftruncate(fd, 0)
            os.lseek(fd, 0, os.SEEK_SET)
        found = json.dumps([False, ran(source) == 0, text(1), text(2)]).encode() + b"\n"
        while found:
            found = found[os.write(to, found) :]
    return 0


def results(sources: list, timeout: float, shared: bool):
    at = 0
    while at < len(sources):
        if not shared:
            yield alone(sources[at], timeout)
            at += 1
            continue
        source, to = os.pipe()
        pid, files = forked(lambda at=at, to=to: together(sources[at:], to))
        os.close(to)
        buffer = b""
        try:
            while at < len(sources):
                if not select.select([source], [], [], timeout)[0]:
                    yield [True, False, "", ""]
                    at += 1
                    break
                data = os.read(source, 1 << 16)
                if not data:
                    yield alone(sources[at], timeout)
                    at += 1
                    break
                *lines, buffer = (buffer + data).split(b"\n")
                for line in lines:
                    found = json.loads(line)
                    # a message that doesn't begin as plain errors do may be one that a process gives only once
                    yield found if found[1] or found[3].startswith(FAILED) else alone(sources[at], timeout)
                    at += 1
        finally:
            ended(pid)
            for fd in (source, *files):
                os.close(fd)


def main() -> None:
    """For each job a line a result, [job, late, passed, stdout, stderr], and [job] at its end."""
    work = json.load(sys.stdin)
    for k, job in enumerate(work["jobs"]):
        sources = [job["code"] + x for x in job["sources"]]
        for i, found in enumerate(results(sources, work["timeout"], keeps_to_itself(job["code"]))):
            os.write(1, json.dumps([k, *found]).encode() + b"\n")
            if job["wanted"] and (found[0] or (found[2].strip() if found[1] else "__error__:" + found[3][:60]) != job["wanted"][i]):
                break
        os.write(1, json.dumps([k]).encode() + b"\n")


if __name__ == "__main__":
    main()
