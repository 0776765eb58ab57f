"""Documents for the stream reader's tests, kept in a folder: one file a document, in the order of their numbers."""

import os


def latest(options):
    return len([f for f in os.listdir(options["at"]) if f.endswith(".xml")])


def between(begin, end, options):
    for i in range(begin, end):
        with open(f"{options['at']}/{i}.xml") as f:
            text = f.read()
        yield f"d{i}", None if text == "null" else text.encode()


def done(end, options):
    with open(f"{options['at']}/done", "a") as f:
        f.write(f"{end}\n")


def failing(begin, end, options):
    """As between(), but document 5 can't be read as long as there is a file `broken`."""
    for doc, data in between(begin, end, options):
        if doc == "d5" and os.path.exists(f"{options['at']}/broken"):
            raise OSError("not now")
        yield doc, data
