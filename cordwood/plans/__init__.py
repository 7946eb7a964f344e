"""cordwood.plans"""
