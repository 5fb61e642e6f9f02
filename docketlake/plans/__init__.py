"""docketlake.plans"""
