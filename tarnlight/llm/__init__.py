"""Operators for training-data corpora: ten text and vector operators and the corpus pipeline's stages.

Nothing outside this subpackage imports it.  Functions run inside tasks are pickled by value, as all of the package's are, and
what they need is broadcast by ``common.sent``, so executors need no copy of this package on their path.
"""
