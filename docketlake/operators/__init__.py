"""docketlake.operators"""
