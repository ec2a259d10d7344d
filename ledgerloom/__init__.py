"""Settlement reconciliation as Spark DataFrame jobs.

``plans.close.close`` runs one close over many merchants and periods;
``operators`` holds the single steps, ``sources`` the readers and writers.
"""
