from gleaner.cli import run

run()
