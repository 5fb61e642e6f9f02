"""docketlake.sources"""
