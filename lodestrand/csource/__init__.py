"""C source text: tokens, conditions, macros and preprocessing of one translation unit.

These kernels run inside one task for one unit, because macro tables and conditionals depend on all that
comes before; units run in parallel through ``lodestrand.operators.source_scan``.
"""
