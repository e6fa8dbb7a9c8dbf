"""SQL expressions as text, to be used with F.expr, selectExpr, where and the like.

One text is parsed in one call, where the same expression put together from Column objects
takes a call to the JVM per operator.
"""
