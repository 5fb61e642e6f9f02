"""docketlake.functions"""
