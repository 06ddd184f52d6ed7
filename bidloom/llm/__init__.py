"""Training-data operators at corpus scale.

Each module holds one operator with a general interface; ``registry`` derives the
registered queries from them.  Nothing outside this package imports it.
"""
