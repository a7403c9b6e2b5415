"""Context scanners: detectors that walk the words around a value. They run inside Arrow batches.

A scanner is a function of a Context that yields Span tuples; registering it makes it part of every
detection. Spans are in characters here and become byte ranges when a batch is packed."""

from veilframe.operators.scan.context import SCANNERS, Context, Span, scan, scanner  # noqa: F401
from veilframe.operators.scan import address, dates, names, passport  # noqa: F401, E402  registration
