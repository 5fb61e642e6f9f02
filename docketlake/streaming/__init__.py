"""docketlake.streaming"""
